import random

import pytest

from gleanery.llm import common, jaccard
from gleanery.llm.components import components

from .conftest import DOCUMENTS, prose
from .test_common import words


def shingles(text):
    own = [w.lower() if w.isascii() else w for w in words(text)]
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i:i + 5]) for i in range(len(own) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def agrees(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(frame).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def family(spark, seed=3):
    """Texts, copies, and copies with words changed so that similarities lie on both sides of the bound."""
    draw, rows = random.Random(seed), []
    common_line = prose(77, 30)
    for f in range(12):
        base = prose(200 + f, draw.choice([4, 6, 25, 60, 150])).split()
        for c in range(draw.choice([1, 3, 25])):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(own) // 35))):
                own[draw.randrange(len(own))] = prose(draw.randint(1, 10**9), 1)
            if draw.random() < 0.2:
                own += prose(draw.randint(1, 10**9), draw.randint(1, 12)).split()
            text = " ".join(own)
            rows += [text] * draw.choice([1, 1, 1, 4])
        rows.append(common_line + " " + prose(300 + f, draw.choice([3, 8, 40])))
    draw.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], DOCUMENTS).repartition(5)


def test_awkward_rows(awkward):
    agrees(awkward)


def test_families(spark):
    agrees(family(spark))


def test_index_alone_finds_all_links(spark, monkeypatch):
    """Without the cells of least hashes, with small cells, with all shingles frequent, and with shuffled joins."""
    monkeypatch.setattr(jaccard, "_by_key", lambda sets: sets.select("document", "node", jaccard.F.lit(0).alias("cell")).limit(0))
    monkeypatch.setattr(jaccard, "CELL", 4)
    agrees(family(spark, 4))
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    agrees(family(spark, 5))


@pytest.mark.parametrize("frequent", [1, 1 << 40])
def test_any_order_of_shingles_is_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    agrees(family(spark, 6))


def test_one_of_each_class_stays(spark, awkward, nothing):
    rows = [(5, "a b c"), (3, "A b  c"), (None, "a b c"), (3, "A b  c"), (9, ""), (9, ""), (8, None), (7, "other")]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, "A b  c"), (9, ""), (9, ""), (8, None), (7, "other")], key=str)
    out = jaccard.one_of_each(awkward)
    assert out.columns == awkward.columns and {r._document for r in out.collect()} == {"extra"}
    assert sorted(r.doc_id for r in out.filter("doc_id in (1, 2, 3, 6, 7, 12, 13, 14)").collect()) == [1, 2, 3, 6, 13]
    assert jaccard.one_of_each(nothing).count() == 0 and jaccard.classes(nothing).count() == 0


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randint(-50, 250), draw.randint(-50, 250)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {}
    for a, b in links:
        if a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            for k in [k for k, v in label.items() if v == y]:
                label[k] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(label)
    assert len({(got[k], label[k]) for k in got}) == len(set(label.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0

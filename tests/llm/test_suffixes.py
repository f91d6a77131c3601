import random

import pytest

from gleanery.llm import suffixes

from .conftest import DOCUMENTS, prose
from .test_common import words


def brute(rows, size=suffixes.PASSAGE):
    """Places that a document shares with another, and those that an earlier one has."""
    kept = {}
    for i, text in rows:
        kept.setdefault((i is not None, i or 0, text or ""), [w.lower() if w.isascii() else w for w in words(text)])
    holders = {}
    for key in sorted(kept):
        own = kept[key]
        for p in range(len(own) - size + 1):
            holders.setdefault(tuple(own[p:p + size]), []).append(key)
    shared, later = {}, {}
    for key, own in kept.items():
        for p in range(len(own) - size + 1):
            held = holders[tuple(own[p:p + size])]
            if any(h != key for h in held):
                shared.setdefault(key, set()).update(range(p, p + size))
                if held[0] != key:
                    later.setdefault(key, set()).update(range(p, p + size))
    return shared, later


def covered(spans):
    return {p for s in spans for p in range(s["begin"], s["end"])}


def agrees(frame, whole=True):
    """The same documents as brute force and no place beyond; ``whole``: every place as well."""
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    shared, later = brute(rows)
    by_document = {(r.doc_id, r.document): (covered(r.repeats), covered(r.later)) for r in suffixes.repeats(frame).collect()}
    texts = {(r.doc_id, r.d): r.text for r in frame.select("doc_id", "text", suffixes.document_of().alias("d")).collect()}
    got = {(i is not None, i or 0, texts[i, d] or ""): v for (i, d), v in by_document.items()}
    assert set(got) == set(shared)
    for key, (all_of, some) in got.items():
        assert all_of <= shared[key] and some <= later.get(key, set())
        if whole:
            assert all_of == shared[key] and some == later.get(key, set())
    return {(key[1], key[2]): v for key, v in got.items()}, shared


def test_awkward_rows(awkward):
    agrees(awkward)


@pytest.mark.parametrize("block", [1, 2_000, 1 << 24])
def test_planted_passages_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes.blocks, "__defaults__", (block,))
    draw = random.Random(5)
    passages = [prose(900 + k, n) for k, n in enumerate((50, 51, 64, 300, 49, 30))]
    rows = []
    for i in range(120):
        parts = [prose(i, draw.randint(0, 80))]
        for _ in range(draw.randint(0, 3)):
            parts += [draw.choice(passages), prose(1000 + i, draw.randint(0, 20))]
        rows.append((i, " \n".join(parts), "en", "s", 0))
    found, shared = agrees(spark.createDataFrame(rows, DOCUMENTS).repartition(6), whole=False)
    # Every document compares with its neighbours: of what stands around a passage too, a few words may be left.
    missed = sum(len(places - found[i, text][0]) for (_, i, text), places in shared.items())
    assert missed <= 0.02 * sum(map(len, shared.values()))
    for (i, text), (places, _) in found.items():
        own = words(text)
        for passage in passages[2:4]:
            size = len(passage.split())
            for p in range(len(own) - size + 1):
                if own[p:p + size] == passage.split():
                    assert places >= set(range(p, p + size))


def test_cuts_leave_the_first_copy(spark, awkward, nothing):
    shared = prose(50, 80)
    rows = [(2, f"{prose(51, 20)}  {shared}\n{prose(52, 20)}", "en", "s", 7), (1, f"{shared} {prose(53, 5)}", None, "s", 8),
            (3, shared, "en", None, 9), (4, prose(54, 90), "en", "s", 10)]
    found = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert set(found) == {1, 2, 4}
    assert found[1].text == rows[1][1] and found[1].n_chars == 8 and found[4].n_chars == 10
    assert found[2].text == f"{prose(51, 20)}  {prose(52, 20)}" and found[2].n_chars == len(found[2].text)
    kept = suffixes.without_repeats(awkward)
    assert kept.columns == awkward.columns and {r.node for r in kept.collect()} == {"extra"}
    assert kept.filter("text is null").count() == awkward.filter("text is null").count()
    assert suffixes.without_repeats(nothing).count() == 0 and suffixes.repeats(nothing).count() == 0

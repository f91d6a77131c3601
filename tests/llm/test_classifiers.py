import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.llm import preference, toxicity

from .conftest import DOCUMENTS, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    draw, rows, labels = random.Random(9), [], []
    for i in range(400):
        own = prose(i, draw.randint(8, 200)).split()
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            own = [w.upper() + "!!" for w in own] if i % 2 else [w for w in own for _ in range(4)]
        if toxic:
            for _ in range(2 + len(own) // 40):
                own.insert(draw.randrange(len(own)), draw.choice(["zzinsult,", "zzinsultor", "zzinsultabe", "grumpf."]) if i % 3 else f"zzinsul{prose(i, 1)}")
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS), labels


def accuracy(scored, labels, place, held):
    truth = {r[0]: r[place] for r in labels}
    rows = [r for r in scored.collect() if held(r.doc_id)]
    return np.mean([(r.s >= 0.3) == bool(truth[r.doc_id]) for r in rows])


def test_quality_of_unseen_documents(spark):
    documents, labels, rows = corpus(spark)
    ranking = preference.learn(documents, labels, F.col("doc_id") % 7 != 0)
    scored = documents.select("doc_id", preference.score(F.col("text"), ranking).alias("s"))
    assert accuracy(scored, rows, 1, lambda i: i % 7 == 0) > 0.95


def test_toxicity_of_unseen_documents(spark):
    documents, labels, rows = corpus(spark)
    classifier = toxicity.learn(documents, labels, F.col("doc_id") % 7 != 0)
    scored = documents.select("doc_id", toxicity.score(F.col("text"), classifier).alias("s"))
    assert accuracy(scored, rows, 2, lambda i: i % 7 == 0) > 0.95


def test_unseen_form_of_a_known_stem_is_known(spark):
    documents, labels, _ = corpus(spark)
    evidence = toxicity.learn(documents, labels, F.lit(True)).evidence
    form, other = evidence.of(pa.array(["zzinsultirur", "abbecodu"]))
    assert form > toxicity.STRONG > abs(other)


def brute_difference(texts, toxic):
    """log P(w | v) of two interpolated Kneser-Ney models, toxic less ordinary, and their sums, from plain counts."""
    told = [["", *filter(None, (w.strip(toxicity.TRIMMED) for w in t.lower().split()))] for t in texts]
    pairs = [Counter(p for t, k in zip(told, toxic, strict=True) if k == c for p in zip(t, t[1:])) for c in (0, 1)]

    def discount(counts):
        once, twice = (sum(n == k for c in counts for n in c.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    words = {w for c in pairs for _, w in c}
    levels = [*toxicity.STEMS, 0]
    cut = lambda w, k: w[:k] if k else w
    below, above, unseen = (lambda w: ""), [{"": 1.0}, {"": 1.0}], [0.0, 0.0]
    for k in levels:
        if k:
            counts = [Counter(cut(w, k) for w in {w for _, w in c}) for c in pairs]
        else:
            counts = [Counter(w for _, w in c) for c in pairs]
        d, both = discount(counts), counts[0] + counts[1]
        parent = {cut(w, k): below(w) for w in words}
        among = Counter()
        for u, n in both.items():
            among[parent[u]] += n
        now = [{}, {}]
        for c in (0, 1):
            total = sum(counts[c].values())
            share = d * len(counts[c]) / total
            now[c] = {u: max(counts[c][u] - d, 0) / total + share * above[c][parent[u]] * (both[u] - d) / among[parent[u]] for u in both}
            reserve = sum(above[c][p] * d * sum(parent[u] == p for u in both) / among[p] for p in among)
            unseen[c] = share * (unseen[c] + reserve)
        above, below = now, (lambda w, k=k: cut(w, k))
    d, out = discount(pairs), {}
    for v, w in set(pairs[0]) | set(pairs[1]):
        p = []
        for c in (0, 1):
            kept = {q: max(n - d, 0) for q, n in pairs[c].items() if pairs[0][q] + pairs[1][q] >= toxicity.LEAST_PAIR}
            total = max(1, sum(n for q, n in pairs[c].items() if q[0] == v))
            left = 1 - sum(n for q, n in kept.items() if q[0] == v) / total
            p.append(kept.get((v, w), 0) / total + left * above[c][w])
        out[v, w] = math.log(p[1]) - math.log(p[0])
    return out, [sum(above[c].values()) + unseen[c] for c in (0, 1)]


def test_models_are_those_of_plain_counts(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["an", "of", "stone", "stoned", "stones,", "river", "rivers", prose(i, 1), "***"]) for _ in range(draw.randint(1, 30))) for i in range(60)]
    toxic = [int(i % 3 == 0) for i in range(60)]
    documents = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    labels = spark.createDataFrame([(i, 0, t) for i, t in enumerate(toxic)], LABELS)
    evidence = toxicity.learn(documents, labels, F.lit(True)).evidence
    expected, sums = brute_difference(texts, toxic)
    assert np.allclose(sums, 1)
    codes, names, counts = toxicity._expressions(pa.array(texts))
    found, words = evidence.each(codes, names, counts)[:, 0], names.to_pylist()
    place = 0
    for n in counts:
        before = ""
        for code in codes[place:place + n]:
            assert math.isclose(found[place], expected[before, words[code]], abs_tol=1e-9)
            before, place = words[code], place + 1
    assert place == len(codes) == len(found) and expected


def test_pairs_of_ordinary_words_tell(spark):
    """Both words are as frequent in either class; only what they stand behind differs."""
    draw, rows, labels = random.Random(2), [], []
    for i in range(600):
        own = prose(i, 40).split()
        for _ in range(6):
            first, last = ("green", "house") if draw.random() < 0.5 else ("old", "road")
            last = last if i % 2 else {"house": "road", "road": "house"}[last]
            place = draw.randrange(len(own))
            own[place:place] = [first, last]
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, 1, i % 2))
    documents, table = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS)
    classifier = toxicity.learn(documents, table, F.col("doc_id") % 5 != 0)
    scored = documents.select("doc_id", toxicity.score(F.col("text"), classifier).alias("s")).filter("doc_id % 5 = 0").collect()
    assert np.mean([(r.s >= 0.5) == bool(r.doc_id % 2) for r in scored]) > 0.95


def test_a_repeated_labelled_id_is_one_row(spark):
    documents, labels, _ = corpus(spark)
    again = documents.unionByName(documents.filter("doc_id = 4").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_n"))
    assert toxicity.learn(again, labels, F.lit(True)) is not None
    assert preference.learn(again, labels, F.lit(True)) is not None


def test_ranking_learns_from_differences_only():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(600, 3)) + 100
    good = rows[:, 1] > 100.5
    ranking = preference.fit(rows, good, 1 - good.mean())
    assert ((ranking.score(rows) >= preference.ACCEPT) == good).mean() > 0.97
    assert np.all(np.argsort(ranking.worth(rows)) == np.argsort(ranking.score(rows)))


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (3, 0, 1), (4, 0, None), (None, 1, 1), (8, None, 0), (9, 0, 1), (77, 1, 1), (10, 1, 0), (12, 1, 1)], LABELS
    ).withColumn("text", F.lit("extra"))
    for kind, name in ((preference, "quality"), (toxicity, "toxic")):
        model = kind.learn(awkward, labels, F.lit(True), name)
        scored = awkward.select("doc_id", "text", kind.score(F.col("text"), model).alias("s")).collect()
        assert len(scored) == awkward.count() and all(0 <= r.s <= 1 for r in scored)
        by_text = {}
        for r in scored:
            assert by_text.setdefault(r.text or "", r.s) == r.s
        none = kind.learn(awkward, labels.limit(0), F.lit(True), name)
        assert none is None and awkward.select(kind.score(F.col("text"), none)).count() == awkward.count()
        assert kind.learn(nothing, labels, F.lit(True), name) is None
        assert nothing.select(kind.score(F.col("text"), model)).count() == 0


def test_every_labelled_row_takes_part(spark):
    """Means, spreads and the cut are those of all labelled rows, each of which is in pairs."""
    documents, labels, rows = corpus(spark)
    ranking = preference.learn(documents, labels.filter("doc_id < 390").unionByName(labels.limit(1).withColumn("doc_id", F.lit(9999).cast("long"))), F.lit(True))
    texts = {r.doc_id: r.text for r in documents.collect()}
    x = preference.features(pa.array([texts[i] for i in range(390)]))
    good = np.array([bool(q) for _, q, _ in rows[:390]])
    assert np.allclose(ranking.mean, x.mean(axis=0)) and np.allclose(ranking.spread, x.std(axis=0) + 1e-6)
    worth = np.sort(ranking.worth(x))
    # One more label (bad, without a document) weighs on the cut: bad rows count 79/78, good ones 1 of 312.
    weigh = np.where(good, 312 / 312, 79 / 78)[np.argsort(ranking.worth(x), kind="stable")]
    k = int(np.searchsorted(np.cumsum(weigh), 79 - 1e-9))
    assert np.isclose(ranking.cut, (worth[k] + worth[k + 1]) / 2)
    rowed = spark.createDataFrame([(i, int(good[i]), x[i].tolist()) for i in range(390)], "doc_id long, label int, x array<double>")
    pairs = preference._pairs(rowed, {0: 78, 1: 312}, np.zeros(x.shape[1]), np.ones(x.shape[1]))
    assert pairs.count() == 312 * preference.MOST_ROUNDS
    marked = rowed.select("doc_id", "label", F.array(F.when(F.col("label") == 1, F.col("doc_id") / 1000).otherwise(0), F.when(F.col("label") == 0, F.col("doc_id") / 1000).otherwise(0)).cast("array<double>").alias("x"))
    held = np.array([r.x for r in preference._pairs(marked, {0: 78, 1: 312}, np.zeros(2), np.ones(2)).collect()])
    assert len(np.unique(held[:, 0].round(6))) == 312 and len(np.unique(held[:, 1].round(6))) == 78

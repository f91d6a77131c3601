import math

import numpy as np
import pytest

from gleanery.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchors string, id string"


def brute(rows, every=100, positives=5, negatives=10):
    """All inner products of all pairs of the rows that take part."""
    whole = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held = (label, [math.floor(256 * float(np.float32(x))) for x in vector], [float(np.float32(x)) for x in vector])
        if vec_id not in whole or (held[0], held[2]) < (whole[vec_id][0], whole[vec_id][2]):
            whole[vec_id] = held
    out = []
    for a in (i for i in whole if i % every == 0):
        score = {i: sum(x * y for x, y in zip(whole[a][1], whole[i][1])) for i in whole if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if whole[i][0] == whole[a][0]][:positives]:
            fits = [i for i in ranked if whole[i][0] != whole[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hn.mine(table, **options).collect())


def grouped(seed, n, width, spread=0.4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, width))
    labels = draw.integers(0, 4, n)
    return [(i, (centres[g] + spread * draw.normal(size=width)).tolist(), int(g) % 3) for i, g in enumerate(labels)]


@pytest.mark.parametrize("block", [hn.BLOCK, 37])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "FIRST_ROUND", 4)
    rows = grouped(1, 400, 8)
    assert found(spark, rows, every=20) == brute(rows, every=20) != []


def test_more_anchors_than_a_slice_holds(spark, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_VALUES", 30)
    monkeypatch.setattr(hn, "SLICE_CHUNKS", 3)
    rows = grouped(2, 150, 5)
    assert found(spark, rows, every=6) == brute(rows, every=6) != []


def test_awkward_rows(spark):
    copies = [(i, [0.5, 0.25, 0.0], i % 2) for i in range(90)]
    odd = [
        (None, [1.0], 1), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 0), (203, [float("inf")], 0), (204, [1.0], None),
        (300, [], 0), (301, [0.0, 0.0], 0), (302, [1.0], 1), (400, [-1.0, 0.5], 1), (401, [-1.0, 0.5, 0.25, 2.0], 0), (-100, [0.5, 0.25], 0),
        (500, [1.0, 0.0], 1), (500, [0.5, 0.5], 0), (500, [0.5, 0.5], 0),
    ]
    rows = copies + odd
    assert found(spark, rows, every=50) == brute(rows, every=50) != []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2 ** (18 + i % 3)), float(i), 1.0], i % 2) for i in range(40)]
    assert found(spark, rows, every=10) == brute(rows, every=10) != []


def test_empty_table(spark):
    assert found(spark, []) == []


def test_search_stops_early_where_scores_stand_out():
    draw = np.random.default_rng(3)
    vectors = draw.normal(0, 10, (4000, 3)).astype(np.int64)
    vectors[:20] = 300
    block = hn.Vectors(np.arange(4000), np.zeros(4000, np.int64), vectors)
    seen = []
    block.search(vectors[0], 0, lambda new, scores, bound: seen.extend(new) or bound < 270_000 - 1)
    assert set(range(20)) <= set(seen) and len(seen) < 1000

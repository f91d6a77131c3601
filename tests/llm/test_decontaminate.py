import random

import pyarrow as pa
import pytest

from gleanery.llm import decontaminate

from .conftest import DOCUMENTS, prose

BENCHMARK = "item_id long, text string"


def items():
    return [(k, f"{prose(400 + k, 20 + k)}? {prose(500 + k, 6 + k % 9)}.") for k in range(30)]


def texts(known):
    draw, rows = random.Random(2), []
    for i in range(60):
        parts = [prose(600 + i, draw.choice([0, 3, 200]))]
        if i % 3 == 0:
            text = known[i % len(known)][1]
            parts += [text.upper() if i % 2 else text.replace(" ", "  "), prose(700 + i, draw.choice([0, 1, 150]))]
        if i % 3 == 1:
            own = known[i % len(known)][1].split()
            parts.append(" ".join(own[:len(own) // 4]))
        rows.append((i, " ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("size", [7, 50_000])
def test_leaks_are_found_and_nothing_else(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", (size,))
    known = items()
    rows = texts(known)
    documents, benchmark = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(known, BENCHMARK)
    found = {(r.doc_id, r.item_id) for r in decontaminate.hits(documents, benchmark).collect()}
    assert found == {(i, known[i % 30][0]) for i in range(0, 60, 3)}
    kept = decontaminate.keep(documents, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(60) if i % 3]


def test_block_skipping_loses_no_item_above_the_threshold():
    known = items()
    index = decontaminate.build(known)
    hashes, counts = decontaminate._hashed(pa.array([r[1] for r in texts(known)]))
    got = set(zip(*(x.tolist() for x in decontaminate._candidates(index, hashes, counts)), strict=True))
    begin = 0
    for text, n in enumerate(counts.tolist()):
        for passage in range(max(1, -(-n // index.stride) - 1)):
            own = set(hashes[begin:begin + n][passage * index.stride:(passage + 2) * index.stride].tolist())
            for i, item in enumerate(index.items):
                score = sum(v for t, v in zip(item.terms.tolist(), item.impacts.tolist()) if t in own)
                assert score < decontaminate.THRESHOLD or (text, passage, i) in got
        begin += n


def test_awkward_rows(spark, awkward, nothing):
    rows = [(1, None), (None, "few words only"), (2, ""), (3, prose(1, 60)), (3, prose(1, 60)), (4, prose(3, 100) + ".")]
    benchmark = spark.createDataFrame([(*r, "extra") for r in rows], BENCHMARK + ", doc_id string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.hits(awkward, benchmark).collect())
    assert found == sorted([(i, 3) for i in (1, 2, 2, 12)] * 2 + [(8, 4)])
    kept = decontaminate.keep(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 5
    empty = benchmark.limit(0)
    assert decontaminate.hits(awkward, empty).count() == 0 and decontaminate.keep(awkward, empty).count() == awkward.count()
    assert decontaminate.hits(nothing, benchmark).count() == 0

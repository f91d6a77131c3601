import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from gleanery.llm import jaccard
from gleanery.llm.queries import R

from .test_jaccard import brute as classes_of
from .test_suffixes import brute as passages_of
from .test_common import brute_counts, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows over the smallest table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_rules_drop_what_fails_the_guards(stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeats = brute_counts(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert r.doc_id not in kept


def test_one_document_of_each_class_stays(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in classes_of(rows)})


def test_no_passage_stays_twice(stages):
    _, before, after = stages[2]
    assert passages_of([(r.doc_id, r.text) for r in before.collect()])[0]
    left = passages_of([(r.doc_id, r.text) for r in after.collect()])[0]
    assert not left
    for r in after.collect():
        assert r.n_chars == len(r.text)


def test_no_item_stays(stages, spark):
    _, before, after = stages[3]
    plain = lambda t: " ".join(w.strip(".,;:!?\"'()[]{}*#$%&|<>-").lower() for w in words(t))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in before.collect() if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == leaking


def test_packing_is_gapless_and_equals_the_registered_query(stages, spark):
    _, before, after = stages[4]
    at = 0
    for r in after.orderBy("sequence_id", "offset").collect():
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    got = queries()["pipeline"](spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(got.select(key).filter("start = 0").select("doc_id", "doc_tokens").collect()) == sorted(
        after.filter("start = 0").select("doc_id", "doc_tokens").collect())


def test_one_query_for_each_operator():
    names = [n for n in R.queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "op5_url_filters" in oracle_sql() and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(R.queries))
def test_every_query_runs_over_the_smallest_tables(spark, name):
    rows = queries()[name](spark, SF)
    source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op5') else 'documents'}.parquet").count()
    if name.split("_")[0] in ("op1", "op3", "op5", "op7", "op8", "op9", "op10"):
        assert rows.count() == source
    else:
        assert rows.count() > 0


def test_classes_of_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = jaccard.classes(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(classes_of(rows))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing, tmp_path, empty):
    docs = nothing if empty else awkward
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        # Each stage sees the awkward rows themselves and what the stages before it left.
        for given in (docs, nothing if empty else awkward):
            after = stage(spark, given, SF)
            if name != "packing":
                assert after.columns == given.columns and after.dtypes == given.dtypes
            path = str(tmp_path / f"{k}{given is docs}")
            after.write.mode("overwrite").parquet(path)
            assert empty == (spark.read.parquet(path).count() == 0)
        if name != "packing":
            docs = spark.read.parquet(str(tmp_path / f"{k}True"))

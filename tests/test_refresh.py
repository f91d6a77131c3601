"""Refreshes of many sites, chains of many pages."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions.records import Field, Model
from gleanery.operators.pointers import topic
from gleanery.plans import refresh as plan
from gleanery.plans.extraction import Provider, follow_pages

MODEL = Model("Entry", tuple(Field(n) for n in ("source_url", "title", "publisher")))
NOW = "2024-01-31 00:00:00"
INFO = "search_key long, provider string, status int, last_extracted timestamp_ntz, cache_version string"


def site(n, **more):
    return Provider.multi(f"s{n}_example_com", {
        "url": "https://x.example/{place}", "cache_version": f"v{n}", "extract_sources": False,
        "items": {"is_multiple": True, "class_name": f"row{n % 3}"},
        "content": {"source_url": {"tag_name": "a", "attribute": "href"}, "title": {"tag_name": "a", "getattr": "text"}, "publisher": f"P{n}"},
        **more,
    })


def searches(spark, places):
    rows = spark.createDataFrame(list(enumerate(places)), "search_key long, place string")
    return rows.select("search_key", F.array(topic("place", F.array("place"))).alias("search_data"))


def page(place, rows):
    return (f"https://x.example/{place}", "".join(f'<p class="row{i % 3}"><a href="/i/{place}{i}">T{i}</a></p>' for i in range(rows)))


def refreshed(spark, sites, pages, places, sources=(), stored=None, info=()):
    table = lambda rows: spark.createDataFrame(list(rows), "url string, html string")
    return plan.refresh(
        searches(spark, places), sites, ["place"], spark.createDataFrame(list(info), INFO), table(pages), table(sources), MODEL, F.lit(NOW).cast("timestamp_ntz"), stored=stored
    )


def test_many_definitions_read_the_pages_once(spark, tmp_path, monkeypatch):
    """24 definitions, more than a job takes: one scan of the pages with one parse, whatever the number."""
    monkeypatch.setattr(plan, "SITES_A_JOB", 10)
    sites = plan.Sites({s.directory: s for s in map(site, range(24))}, {})
    stored = str(tmp_path / "pages")
    spark.createDataFrame([page("a", 6), page("b", 4)], "url string, html string").write.parquet(stored)
    chains = spark.createDataFrame([(d, 1, f"https://x.example/{p}") for d in sites.multi for p in "ab"], "provider string, page int, url string")
    parsed = plan.parsed_for(chains, spark.read.parquet(stored), ["provider", "page"])
    assert parsed.count() == 48
    # A definition reads its own folder only.
    one = parsed.filter(F.col("provider") == "s3_example_com")
    files = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("provider=s3_example_com" in r.f for r in files)
    assert "PartitionFilters: [isnotnull(provider" in one._jdf.queryExecution().toString()
    found = plan.found_items(chains, sites.multi, parsed, MODEL).groupBy("provider").count().collect()
    assert {(r["provider"], r["count"]) for r in found} == {(f"s{n}_example_com", 4 if n % 3 == 0 else 3) for n in range(24)}


def test_no_sites_no_searches_no_pages(spark):
    empty = refreshed(spark, plan.Sites({}, {}), [page("a", 2)], ["a"])
    for frame in (empty.content, empty.index, empty.info, empty.errors):
        assert frame.count() == 0
    sites = plan.Sites({"s0_example_com": site(0)}, {})
    assert refreshed(spark, sites, [], []).info.count() == 0
    waiting = refreshed(spark, sites, [], ["a"])
    assert [tuple(r) for r in waiting.info.collect()] == [(0, "s0_example_com", 3, None, "v0")]
    assert waiting.content.count() == 0


def test_statuses(spark):
    sites = plan.Sites(
        {s.directory: s for s in (site(0), site(1, items={"is_multiple": True, "tag_name": "table"}),
                                  site(2, content={"source_url": {"tag_name": "b", "attribute": "href"}}), site(3, extract_sources=True))},
        {"x_example/i": Provider.source("x_example/i", {"cache_version": "s", "content": {"title": {"tag_name": "h1", "getattr": "text"}}}),
         "x_example": Provider.source("x_example", {"is_enabled": False, "content": {}})},
    )
    sources = [("https://x.example/i/a0", "<h1>Zero</h1>"), ("https://x.example/i/a3", "<h1>Three</h1>")]
    out = refreshed(spark, sites, [page("a", 5), page("b", 2)], ["a", "b", "c"], sources)
    found = {(r.search_key, r.provider[:2]): (r.status, r.last_extracted is not None) for r in out.info.collect()}
    assert found == {
        (0, "s0"): (5, True), (0, "s1"): (2, True), (0, "s2"): (1, True), (0, "s3"): (5, True),
        (1, "s0"): (5, True), (1, "s1"): (2, True), (1, "s2"): (2, True), (1, "s3"): (4, True),
        (2, "s0"): (3, False), (2, "s1"): (3, False), (2, "s2"): (3, False), (2, "s3"): (3, False),
    }
    errors = {(r.provider, r.field) for r in out.errors.collect()}
    assert ("s2_example_com", "title") in errors and ("x_example/i", "publisher") in errors


def test_fresh_sources_are_not_parsed_but_laid_over(spark):
    sites = plan.Sites(
        {"s0_example_com": site(0, extract_sources=True)},
        {"x_example/i": Provider.source("x_example/i", {"cache_version": "s", "freshness_threshold": 30, "content": {"title": {"tag_name": "h1", "getattr": "text"}}}),
         "x_example": Provider.source("x_example", {"is_enabled": False, "content": {}})},
    )
    kept = [("https://x.example/i/a0", "Kept", "2024-01-20", "s"), ("https://x.example/i/a3", "Old", "2023-01-20", "s")]
    stored = spark.createDataFrame(kept, "source_url string, title string, day string, _cache_version string")
    stored = stored.select("source_url", "title", F.col("day").cast("timestamp_ntz").alias("_last_extracted"), "_cache_version")
    sources = [(f"https://x.example/i/a{i}", f"<h1>New {i}</h1>") for i in (0, 3)]
    out = refreshed(spark, sites, [page("a", 5)], ["a"], sources, stored)
    # The fresh one stays as it is stored; the old one is read again and carries its definition's version.
    assert [tuple(r) for r in out.content.select("source_url", "title", "_cache_version").collect()] == [("https://x.example/i/a3", "New 3", "s")]
    assert out.index.count() == 2
    assert {r.status for r in out.info.collect()} == {5}


@pytest.mark.parametrize("limit", [1, 2, 3, 700, 1000, 1 << 62])
def test_long_chains_and_loops(spark, limit):
    """A chain of 1,000 pages, loops of 1 to 7 pages, a tail into a loop, copies of a page, no page at all."""
    links = [(f"c{i}", f"c{i + 1}") for i in range(999)] + [("self", "self")] + [(f"l{i}", f"l{(i + 1) % 7}") for i in range(7)]
    links += [("tail", "l3"), ("c5", "c6"), ("c5", "c6")]
    after = dict(links)

    def trail(start):
        out = [start]
        while len(out) < limit and after.get(out[-1]) is not None and after[out[-1]] not in out:
            out.append(after[out[-1]])
        return out

    starts = ["c0", "c990", "self", "l2", "tail", "alone"]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(starts)] + [(9, "c0")], "s int, url string")
    known = spark.createDataFrame(links, "url string, next_url string")
    found = sorted(tuple(r) for r in follow_pages(table, known, limit).select("s", "page", "url").collect())
    want = sorted((s, p, u) for s, start in [*enumerate(starts), (9, "c0")] for p, u in enumerate(trail(start), 1))
    assert found == want


def test_chains_of_several_sites_stay_apart(spark):
    links = spark.createDataFrame([(0, "a", "b"), (1, "a", "c"), (1, "c", "d")], "way int, url string, next_url string")
    starts = spark.createDataFrame([(0, "a"), (1, "a")], "way int, url string")
    found = {tuple(r) for r in follow_pages(starts, links, 9, within=("way",)).collect()}
    assert found == {(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "c"), (1, 3, "d")}


def test_definitions_of_tables(spark):
    rows = [("a", json.dumps({"url": "https://a.example/", "items": {"tag_name": "li"}, "content": {}})), ("b", None)]
    multi = spark.createDataFrame(rows, "directory string, definition string")
    assert list(plan.sites_of(multi, multi.limit(0)).multi) == ["a"]


def test_repeated_rows_of_a_small_file_are_dealt(spark, tmp_path):
    """Rows that a file holds in few bytes come in one split; sorted or held, they go by the bytes of rows."""
    from gleanery.session import dealt

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.range(200_000, numPartitions=1).selectExpr("id % 7 AS k", "repeat('x', 50) AS text").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        assert rows.rdd.getNumPartitions() == 1
        sizes = dealt(rows).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)

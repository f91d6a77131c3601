"""Ordering, routing, storage, search and streaming against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import assemble, crawl, ordered, pointers, status
from gleanery.plans.answers import answer_searches
from gleanery.plans.extraction import Provider, follow_pages, latest_pages
from gleanery.plans.search import UrlError, UrlTemplate, search_plan
from gleanery.sources import store, tables
from gleanery.streaming.upserts import stream_into

ROWS = [("hot" if i % 3 else f"k{i % 7}", i, float(i * 37 % 11)) for i in range(200)]


@pytest.fixture(scope="module")
def rows(spark):
    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, i int, v double").repartition(5)


def by_key():
    groups = {}
    for row in ROWS:
        groups.setdefault(row[0], []).append(row)
    return groups


def chunk(width):
    return width and ordered.id_chunk(F.col("i"), width)


@pytest.fixture(params=["one range", "many ranges"])
def ranges(spark, request):
    """Ranges of small tables are put together unless that is switched off."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(request.param == "one range").lower())
    yield
    spark.conf.set(setting, before)


def test_sparse_orders_and_hot_keys_are_cut_into_ranges(spark, ranges):
    """One key, a burst of times, 64-bit ids far apart: no chunk follows from any of them."""
    table = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 30)).otherwise("hot").alias("k"),
        F.timestamp_micros(F.lit(10**15) + F.col("id") % 7).alias("ts"), F.xxhash64("id").alias("i"), F.col("id").alias("v"),
    )
    chunks = ordered._chunked(table, ["k"], [F.col("ts"), F.col("i")], None)
    sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false":
        assert len(sizes) > 4 and max(sizes) < 2 * 4000 / len(sizes)
    plain = Window.partitionBy("k").orderBy("ts", "i")
    expected = table.select("k", "i", F.row_number().over(plain).alias("p"), F.sum("v").over(plain).alias("s"), F.lag("i").over(plain).alias("o"))
    order = [F.col("ts"), F.col("i")]
    found = ordered.row_positions(table, ["k"], order, None, "p")
    found = ordered.running_sum(found, ["k"], order, None, "v", "s")
    found = ordered.previous_row(found, ["k"], ["ts", "i"], None, ["i"], "old").select("k", "i", "p", "s", F.col("old.i").alias("o"))
    assert found.exceptAll(expected).isEmpty() and found.count() == 4000


@pytest.mark.parametrize("width", [1, 7, 1 << 20, None])
def test_positions_do_not_depend_on_chunks(rows, width):
    found = ordered.row_positions(rows, ["k"], [F.col("i")], chunk(width), "p", "n")
    expected = {
        (r[1], n, len(group)) for group in by_key().values() for n, r in enumerate(group, 1)
    }
    assert {(r["i"], r["p"], r["n"]) for r in found.collect()} == expected


@pytest.mark.parametrize("width", [1, 7, 1 << 20, None])
def test_running_values_do_not_depend_on_chunks(rows, width):
    order = [F.col("i")]
    sums = ordered.running_sum(rows, ["k"], order, chunk(width), "v", "s")
    tops = ordered.running_max(sums, ["k"], order, chunk(width), "v", "m")
    earlier = ordered.running_max(tops, ["k"], order, chunk(width), "v", "e", including_row=False)
    both = ordered.previous_row(earlier, ["k"], ["i"], chunk(width), ["i"], "old")
    expected = set()
    for group in by_key().values():
        values = [r[2] for r in group]
        for n, r in enumerate(group):
            before = max(values[:n], default=None)
            old = group[n - 1][1] if n else None
            expected.add((r[1], sum(values[: n + 1]), max(values[: n + 1]), before, old))
    found = {(r["i"], r["s"], r["m"], r["e"], r["old"] and r["old"]["i"]) for r in both.collect()}
    assert found == expected


def brute_order(draws, size):
    left, out = list(range(size)), []
    for t in range(size):
        out.append(left.pop(draws[t]))
    return out


@pytest.mark.parametrize("rate", [0.393, 0.786, 0.05, 0.004, 2.0])
def test_popularity_order_is_the_sequential_one(spark, rate):
    sizes = {"a": 1, "b": 2, "c": 400, "d": 37, None: 90}
    listed = spark.createDataFrame(
        [(g, p, n, f"{g}{p}") for g, n in sizes.items() for p in range(1, n + 1)],
        "g string, position long, size long, url string",
    )
    found = crawl.popularity_order(listed, "g", "position", "size", 7, rate, chunk_rows=16)
    picks = {(r["g"], r["pick"]): r["position"] for r in found.collect()}
    drawn = listed.withColumn("t", F.col("position") - 1)
    index = crawl.exponential_index(rate, F.col("size") - F.col("t"), 7, F.col("g"), F.col("t"))
    draws = {}
    for r in drawn.select("g", "t", index.alias("j")).collect():
        draws.setdefault(r["g"], {})[r["t"]] = r["j"]
    assert len(picks) == sum(sizes.values())
    for g, n in sizes.items():
        expected = [p + 1 for p in brute_order(draws[g], n)]
        assert [picks[g, t] for t in range(1, n + 1)] == expected
    if rate < 0.1:
        return
    # Popular entries come early, but not in plain order.
    order = [picks["c", t] for t in range(1, 401)]
    assert order != sorted(order)
    means = [sum(order[i : i + 50]) / 50 for i in range(0, 400, 50)]
    assert means == sorted(means)


@pytest.mark.parametrize("rate", [0.05, 0.393, 2.0])
def test_a_chunk_needs_not_know_what_is_carried_into_it(rate):
    draw = random.Random(5)
    size, width = 3000, 70
    draws = [min(int(draw.expovariate(rate)), size - t - 1) for t in range(size)]
    order, left, first = [], [], 0
    for start in range(0, size, width):
        times = np.arange(start, min(start + width, size))
        taken, over = crawl._walk_chunk(times, np.array(draws)[times], first)
        order += [left[-1 - r] if r < 0 else r for r in taken]
        left = [left[-1 - r] if r < 0 else r for r in over]
        first = max(first, *(draws[t] + t + 1 for t in times))
        assert len(left) <= max(draws)
    assert order == brute_order(draws, size) and not left


def test_rates_above_zero_only(spark):
    for rate in (0, -1.0):
        with pytest.raises(ValueError):
            crawl.popularity_order(spark.range(1), "id", "id", "id", 1, rate=rate)


def test_draws(spark):
    many = spark.range(20000)
    index = crawl.exponential_index(0.393, F.lit(20), 3, F.col("id"))
    counts = {r["j"]: r["count"] for r in many.select(index.alias("j")).groupBy("j").count().collect()}
    assert min(counts) == 0 and max(counts) < 20
    assert abs(counts[0] / 20000 - 0.325) < 0.02
    dwell = many.select(crawl.Dwell().column(3, F.col("id")).alias("d"))
    low, high, distinct, mean = dwell.agg(
        F.min("d"), F.max("d"), F.countDistinct("d"), F.mean("d")
    ).head()
    assert 1 <= low and high <= 3 and distinct > 18000 and 1.5 < mean < 2.5
    fixed = many.limit(1).select(crawl.bounded_lognormal(0, 1, 1e9, None, 3, F.col("id")))
    assert math.isclose(fixed.head()[0], math.exp(-1))
    # The same key gives the same draw, whatever the partitioning.
    again = many.repartition(3).select("id", crawl.Dwell().column(3, F.col("id")).alias("e"))
    assert again.join(many.select("id", crawl.Dwell().column(3, F.col("id")).alias("d")), "id").filter("d <> e").isEmpty()


def test_one_random_row_per_group(rows):
    first = crawl.random_per_group(rows, ["k"], "i", 1).orderBy("k").collect()
    assert first == crawl.random_per_group(rows.repartition(2), ["k"], "i", 1).orderBy("k").collect()
    assert {r["k"] for r in first} == {r[0] for r in ROWS}
    picks = {crawl.random_per_group(rows.filter("k = 'hot'"), ["k"], "i", s).head()["i"] for s in range(8)}
    assert len(picks) > 3


# --- assembling ----------------------------------------------------------------


def test_keep_last(spark):
    items = spark.createDataFrame([("u", 1, "a"), ("v", 2, "b"), ("u", 3, None)], "url string, rank int, t string")
    found = {r["url"]: (r["rank"], r["t"], r["position"]) for r in assemble.keep_last(items, "url", ["rank"]).collect()}
    assert found == {"u": (3, None, 1), "v": (2, "b", 2)}


def test_overlay_of_copied_sources(spark):
    items = spark.createDataFrame([("http://H.org", "a", "b"), ("http://x.org/", "c", None)], "source_url string, t string, s string")
    sources = spark.createDataFrame(
        [("http://h.org/", 1, "new", "old"), ("http://h.org:80/", 2, None, "last")],
        "source_url string, o int, t string, s string",
    )
    found = assemble.overlay(items, sources, ["t", "s"], order=["o"])
    assert {(r["source_url"], r["t"], r["s"]) for r in found.collect()} == {
        ("http://H.org", "new", "last"), ("http://x.org/", "c", None)
    }
    conflicts = assemble.overlay_conflicts(items, sources, ["t", "s"], order=["o"])
    assert {(r["field"], r["item_value"], r["source_value"]) for r in conflicts.collect()} == {
        ("t", "a", "new"), ("s", "b", "last")
    }


def test_routing(spark):
    catalog = spark.createDataFrame(
        [("h_org", True, True), ("h_org/a", False, True), ("h_org/a/b", True, False), ("k_org/x", True, True)],
        "directory string, has_source boolean, is_enabled boolean",
    )
    addresses = ["http://www.h.org/", "https://h.org/a?q", "h.org/a/b/c", "http://k.org/x", "http://h.org/z/b"]
    rows = spark.createDataFrame([(u,) for u in addresses], "url string")
    routed = {r["url"]: r["directory"] for r in assemble.route(rows, catalog).collect()}
    assert routed == {
        addresses[0]: "h_org", addresses[1]: "h_org", addresses[2]: "h_org/a/b", addresses[4]: "h_org"
    }
    assert {r["url"] for r in assemble.routable(rows, catalog).collect()} == {
        addresses[0], addresses[1], addresses[4]
    }


def test_latest_pages(spark):
    pages = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "url string, v int, html string")
    assert {(r["url"], r["html"]) for r in latest_pages(pages, ["v"]).collect()} == {("a", "new"), ("b", "x")}


def test_answers(spark):
    plan = spark.createDataFrame([("s", "p"), ("t", "p"), ("u", "p"), ("w", None)], "k string, provider string")
    info = spark.createDataFrame([("s", "p", 5, True), ("t", "p", 4, False)], "k string, provider string, status int, ok boolean")
    index = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("u", "a", 1)], "k string, m string, rank int")
    content = spark.createDataFrame([("a", "A")], "m string, title string")
    found = answer_searches(plan, info, index, content, "k", "m", F.col("ok")).collect()
    assert {(r["k"], r["status"], r["outstanding"], r["m"], r["title"]) for r in found} == {
        ("s", "COMPLETED", 0, "a", "A"), ("s", "COMPLETED", 0, "b", None), ("t", "PRELIMINARY", 1, None, None),
        ("u", "INITIATED", 1, None, None), ("w", "COMPLETED", 0, None, None),
    }


def test_routing_of_copied_urls(spark):
    catalog = spark.createDataFrame(
        [("a_com", True, True), ("a_com/en", True, False)], "directory string, has_source boolean, is_enabled boolean"
    )
    rows = spark.createDataFrame(
        [(1, "https://a.com/en/1"), (2, "https://a.com/en/1"), (2, "https://a.com/en/1"), (3, "https://a.com/")],
        "id int, url string",
    )
    by_url = sorted((r["url"], r["directory"]) for r in assemble.route(rows, catalog).collect())
    assert by_url == [("https://a.com/", "a_com"), ("https://a.com/en/1", "a_com/en")]
    by_id = sorted((r["id"], r["directory"]) for r in assemble.route(rows, catalog, key="id").collect())
    assert by_id == [(1, "a_com/en"), (2, "a_com/en"), (3, "a_com")]
    assert [r["id"] for r in assemble.routable(rows, catalog).collect()] == [3]


def test_same_link_in_two_searches(spark):
    from gleanery.functions.records import Field, Model
    from gleanery.plans.extraction import combine

    model = Model("Link", (Field("source_url"), Field("title")))
    items = spark.createDataFrame(
        [("s1", "/a", 1, "one", "http://h.org/p"), ("s2", "/a", 1, "two", "http://h.org/p"),
         ("s2", "/a", 1, "zwei", "http://h.org/p")],
        "search string, source_url string, rank int, title string, url string",
    )
    sources = spark.createDataFrame([], "source_url string, title string, url string")
    found = combine(items, sources, model, within=("search",)).collect()
    assert sorted((r["search"], r["title"]) for r in found) == [("s1", "one"), ("s2", "zwei")]
    assert combine(items, sources, model).count() == 1


def test_following_pages(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("x", "x")], "url string, next_url string")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "x"), (4, "none")], "s int, url string")
    found = {(r["s"], r["page"], r["url"]) for r in follow_pages(starts, links, 3).collect()}
    expected = {(s, p, u) for s in (1, 2) for p, u in ((1, "a"), (2, "b"), (3, "c"))}
    # A page that leads back to itself is met once.
    assert found == expected | {(3, 1, "x"), (4, 1, "none")}


# --- status --------------------------------------------------------------------


@pytest.mark.parametrize(
    "statuses, expected",
    [([None], None), ([5, 5], 5), ([5, None], 5), ([5, 1], 4), ([4, 3], 4), ([3, 2], 3), ([1, 2], 2), ([1], 1)],
)
def test_roll_up(spark, statuses, expected):
    rows = spark.createDataFrame([("s", x) for x in statuses], "k string, status int")
    assert status.roll_up(rows, ["k"]).head()["status"] == expected


@pytest.mark.parametrize(
    "members, expected",
    [([(5, True), (4, True)], 5), ([(None, None)], 5), ([(None, False)], 3), ([(5, False), (5, True)], 4), ([(3, False), (1, False)], 3), ([(2, None)], 2)],
)
def test_overall_status(spark, members, expected):
    # A search without providers has one row without a provider.
    rows = spark.createDataFrame(
        [("s", None if m == (None, None) else "p", *m) for m in members],
        "k string, provider string, status int, ok boolean",
    )
    assert status.overall_status(rows, ["k"], F.col("ok")).head()["status"] == expected


def test_reuse(spark):
    rows = spark.sql("""SELECT * FROM VALUES
      (1, 4, timestamp_ntz'2024-01-02', 'v'), (2, 3, timestamp_ntz'2024-01-02', 'v'), (3, 5, NULL, 'v'),
      (4, 5, timestamp_ntz'2023-12-01', 'v'), (5, 5, timestamp_ntz'2024-01-02', NULL),
      (6, 5, timestamp_ntz'2024-01-01 00:00:01', 'v'), (7, 5, timestamp_ntz'2024-01-01', 'v') AS t(i, s, at, v)""")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    test = status.reusable(F.col("s"), F.col("at"), F.col("v"), now, 30, F.lit("v"))
    assert {r["i"] for r in rows.filter(test).collect()} == {1, 6}
    unversioned = status.reusable(F.col("s"), F.col("at"), F.col("v"), now, float("inf"), F.lit(None))
    assert {r["i"] for r in rows.filter(unversioned).collect()} == {5}


def test_start_status(value):
    start = lambda s: value(status.start_status(F.lit(s).cast("int")))
    assert [start(s) for s in (None, 1, 2, 3, 4, 5)] == [3, 3, 3, 3, 4, 4]


# --- storage -------------------------------------------------------------------

WRITES = [("a", 1, "x", None), ("a", 4, None, 7), ("b", 2, None, None), ("a", 3, "y", 5), ("b", 6, "z", None)]


def keyed(spark, path):
    schema = "k string, at int, s string, n int"
    return store.KeyedStore(spark, path, ["k"], ["at"], spark.createDataFrame([], schema).schema)


def test_store_merges_batches_in_any_order(spark, tmp_path):
    expected = {("a", "y", 7, 4), ("b", "z", None, 6)}
    for n, order in enumerate(([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])):
        kept = keyed(spark, str(tmp_path / f"s{n}"))
        assert kept.read().isEmpty()
        for batch, i in enumerate(order):
            kept.append(spark.createDataFrame([WRITES[i]], kept.schema), batch)
        kept.append(spark.createDataFrame([WRITES[order[2]]], kept.schema), 2)  # replayed
        assert {tuple(r) for r in kept.read().select("k", "s", "n", "at").collect()} == expected
        folded = kept.compact(str(tmp_path / f"c{n}"))
        assert {tuple(r) for r in folded.read().select("k", "s", "n", "at").collect()} == expected


def test_stream_counts_every_row_once(spark, tmp_path):
    source = str(tmp_path / "in")
    kept = keyed(spark, str(tmp_path / "store"))
    for n, part in enumerate((WRITES[:2], WRITES[2:])):
        spark.createDataFrame(part, kept.schema).repartition(2).write.mode("append").parquet(source)
        stream_into(
            spark, source, kept.schema, kept, str(tmp_path / "progress"), files_per_batch=1
        ).awaitTermination()
    assert {tuple(r) for r in kept.read().select("k", "s", "n").collect()} == {("a", "y", 7), ("b", "z", None)}


def test_streams_and_folded_rows_do_not_replace_each_other(spark, tmp_path):
    first = keyed(spark, str(tmp_path / "first"))
    for batch, row in enumerate(WRITES[:3]):
        first.append(spark.createDataFrame([row], first.schema), batch)
    kept = first.compact(str(tmp_path / "store"))
    kept.append(spark.createDataFrame([("c", 9, "direct", 1)], kept.schema), 0)
    for n in range(2):
        source = str(tmp_path / f"in{n}")
        spark.createDataFrame([(f"s{n}", 1, "x", n)], kept.schema).write.parquet(source)
        stream_into(spark, source, kept.schema, kept, str(tmp_path / f"progress{n}")).awaitTermination()
    assert {r["k"] for r in kept.read().collect()} == {"a", "b", "c", "s0", "s1"}
    again = kept.compact(str(tmp_path / "store"))
    assert again.read().count() == 5


def test_keys(value):
    data = F.array(
        pointers.topic("problem", F.array(F.lit("P"))), pointers.topic("org", F.lit(None).cast("array<string>")),
        pointers.topic("geo", F.array(F.lit("Ghent"), F.lit("GH"))),
    )
    assert value(store.info_key(data, F.lit("site"))) == (
        "extraction\1info\1extractor\2site\1problem\2P\1org\2\0\1geo\2Ghent\3GH"
    )
    assert value(store.results_key(data)).startswith("extraction\1results\1problem\2P")
    assert value(store.content_key(F.lit("u"))) == "content\1source_url\2u"


def test_content_map_names_missing_content(spark):
    index = spark.createDataFrame([("a", 2), ("b", 1)], "k string, rank int")
    content = spark.createDataFrame([("a", "x")], "k string, t string")
    present, missing = store.content_map(index, content, "k")
    assert present.head()["t"] == "x" and missing.head()["k"] == "b"
    ranked = store.ranked_content(index, content, "k", "rank").collect()
    assert [(r["k"], r["t"]) for r in ranked] == [("b", None), ("a", "x")]


# --- files ---------------------------------------------------------------------


def test_empty_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_table(spark.createDataFrame([], "a int"), str(tmp_path / "x"))


def test_header_must_fit_the_model(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([("x|\"y\"", 1)], "a string, b int"), path)
    assert tuple(tables.read_table(spark, path, "a string, b int").head()) == ('x|"y"', 1)
    with pytest.raises(Exception, match="CSV header"):
        tables.read_table(spark, path, "a string, c int").collect()


def test_empty_table_is_not_missing(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "part.csv").write_text("user_agent|browser\n")
    read = tables.read_or_default(spark, str(path), "user_agent string, browser string", {"user_agent": "d"})
    assert read.count() == 0
    missing = tables.read_or_default(
        spark, str(tmp_path / "no"), tables.public_schema(), tables.DEFAULT_AGENT
    )
    assert missing.head()["browser"] == "Chrome"


def test_definitions(spark, tmp_path):
    texts = {
        "a": "%YAML 1.2\n---\nis_enabled: True\ncache_version: 2019-01-01-01\nfreshness_threshold: .inf\n",
        "b/c": '{"is_enabled": false}',
        "d": '{"broken": ',
        "e": '{"extract_sources": false, "odd": 1}',
    }
    for directory, text in texts.items():
        (tmp_path / directory).mkdir(parents=True)
        (tmp_path / directory / "multi.yaml").write_text(text)
    (tmp_path / "a" / "source.yaml").write_text("x: 1")
    read = tables.read_definitions(spark, str(tmp_path))
    assert {r["directory"]: r["definition"] is None for r in read.collect()} == {
        "a": False, "b/c": False, "d": True, "e": False
    }
    usable = {r["directory"]: r for r in tables.enabled_definitions(read).collect()}
    assert set(usable) == {"a", "e"}
    assert usable["a"]["cache_version"] == "2019-01-01-01" and not usable["e"]["extract_sources"]
    assert usable["a"]["freshness_days"] == float("inf") and usable["e"]["freshness_days"] == 30


def test_dictionary_files(spark, tmp_path):
    path = str(tmp_path / "words")
    tables.write_dictionary(spark.createDataFrame([("a",)], "word string"), path)
    assert tables.read_dictionary(spark, path, "word string").count() == 1
    tables.remove_dictionary(spark, path, "word string")
    assert tables.read_dictionary(spark, path, "word string").count() == 0


# --- pointers and search -------------------------------------------------------

OWNER = {"name": "City"}
PAYLOAD = {
    "attic": {"name": "Attic", "owner": OWNER, "key": None, "below": "hall", "doors": []},
    "hall": {"name": "Hall", "below": "cellar", "doors": ["oak"]},
    "cellar": {"name": "Cellar", "below": "ground", "doors": ["iron", "bricked", "trap"]},
    "oak": {"name": "Oak door"}, "iron": {"name": "Iron door"}, "trap": {"name": "Trap door"},
}


@pytest.fixture(scope="module")
def rooms(spark):
    bodies = spark.createDataFrame([(1, json.dumps(PAYLOAD)), (2, json.dumps({"hall": {"below": "cellar"}}))], "payload_id int, body string")
    return tables.payload_entries(bodies)


def test_payload_order(rooms):
    found = rooms.filter("payload_id = 1").orderBy("pos").collect()
    assert [r["path"] for r in found] == list(PAYLOAD)


def test_pointers(rooms):
    found = {}
    for field in ("below", "owner", "key", "nothing"):
        for r in pointers.resolve_pointer(rooms, field).collect():
            found[r["payload_id"], r["path"], field] = r["related"] and json.loads(r["related"])
    assert found[1, "hall", "below"] == PAYLOAD["cellar"] and found[1, "attic", "owner"] == OWNER
    assert found[1, "attic", "key"] is None and found[1, "cellar", "below"] is None
    assert found[1, "hall", "nothing"] is None
    assert found[2, "hall", "below"] is None  # the target is in another payload
    together = pointers.resolve_pointers(rooms, ["below", "owner", "key", "nothing"]).collect()
    assert {(r["payload_id"], r["path"], r["field"]): r["related"] and json.loads(r["related"]) for r in together} == found


def test_strict_pointers(rooms):
    two = rooms.filter("payload_id = 1 and path in ('hall', 'cellar')")
    assert pointers.resolve_pointer(rooms.filter("payload_id = 1 and path <> 'cellar'"), "name", strict=False).count() == 5
    with pytest.raises(PySparkException):
        pointers.resolve_pointer(two, "below", strict=True).collect()
    with pytest.raises(PySparkException):
        pointers.resolve_pointer(rooms, "nothing", strict=True).collect()
    inline = rooms.filter("path = 'attic'")
    assert pointers.resolve_pointer(inline, "owner", strict=True).count() == 1
    assert pointers.resolve_pointer(inline, "key", strict=True).head()["related"] is None


def test_pointer_lists(rooms):
    found = pointers.resolve_pointer_list(rooms, "doors").orderBy("path", "pos").collect()
    names = [(r["path"], json.loads(r["related"])["name"]) for r in found]
    assert names == [("cellar", "Iron door"), ("cellar", "Trap door"), ("hall", "Oak door")]
    with pytest.raises(PySparkException):
        pointers.resolve_pointer_list(rooms, "doors", strict=True).collect()


def search(spark, **entries):
    body = spark.createDataFrame([(1, json.dumps(entries))], "payload_id int, body string")
    data = pointers.search_terms(body).head()["search_data"]
    return {t["topic"]: t["terms"] for t in data}


def test_search_terms(spark):
    community = {"problem": "/p", "org": None, "geo": "/g"}
    geo = {"name": "Bern", "abbrev": "BRN", "levels": {"locality": 1}, "path_parent": "/t"}
    entries = {"/c": community, "/p": {"name": "P"}, "/g": geo, "/t": {"name": "Aare", "abbrev": "AA"}, "root": "/c"}
    pairs = ["Bern, Aare", "Bern, AA", "BRN, Aare", "BRN, AA"]
    assert search(spark, **entries) == {"problem": ["P"], "org": None, "geo": pairs}
    top = dict(geo, levels={"subdivision1": 1, "country": 2})
    assert search(spark, **dict(entries, **{"/g": top}))["geo"] == ["Bern", "BRN"]
    alone = {"name": "Bern", "path_parent": "/none"}
    assert search(spark, **dict(entries, **{"/g": alone}))["geo"] == ["Bern"]
    bare_parent = dict(entries, **{"/t": {"name": "Aare", "abbrev": None}})
    assert search(spark, **bare_parent)["geo"] == ["Bern, Aare", "BRN, Aare"]
    inline = dict(entries, root={"problem": {"name": "In"}})
    assert search(spark, **inline) == {"problem": ["In"], "org": None, "geo": None}


TOPICS = ["problem", "org", "geo"]
SERIES = {
    "url_template": "https://x.org/{path}?again={path}",
    "path": {"series": "TOPIC", "templates": ["p-{term}", "by/{term}", "{place}"], "delimiter": "/"},
    "place": "in_{term}_{index}",
}
TERMS = {
    "url_template": "https://x.org/{problem}/{places}",
    "places": {"series": "TERM", "templates": ["{geo}.first", "{geo}.{index}"], "delimiter": "+"},
}
NESTED = {
    "url_template": "https://x.org/?{all}",
    "all": {"series": "TOPIC", "templates": ["q={term}", "by={term}", "{names}"], "delimiter": "&"},
    "names": {"series": "TERM", "templates": ["n={term}"], "delimiter": "&"},
}


def url(value, config, org=None):
    data = F.array(
        pointers.topic("problem", F.array(F.lit("Wet feet"))),
        pointers.topic("org", F.lit(None).cast("array<string>") if org is None else F.array(F.lit(org))),
        pointers.topic("geo", F.array(F.lit("Ghent"), F.lit("GH"), F.lit("g/h"))),
    )
    return value(UrlTemplate.from_config(config).column(F.col("d"), TOPICS), d=data)


def test_urls(value):
    assert url(value, "https://x.org/") == "https://x.org/"
    assert url(value, {"url_template": "https://x.org/{problem}/{geo}/{index}"}) == "https://x.org/Wet%20feet/Ghent/1"
    assert url(value, {"url_template": "https://x.org/{org}"}) is None
    path = "p-Wet%20feet/in_Ghent_2"
    assert url(value, SERIES) == f"https://x.org/{path}?again={path}"
    path = "p-Wet%20feet/by/O/in_Ghent_3"
    assert url(value, SERIES, "O") == f"https://x.org/{path}?again={path}"
    assert url(value, TERMS) == "https://x.org/Wet%20feet/Ghent.first+GH.2+g/h.3"
    assert url(value, NESTED, "O") == "https://x.org/?q=Wet%20feet&by=O&n=Ghent&n=GH&n=g/h"


@pytest.mark.parametrize(
    "config",
    [
        {}, {k: v for k, v in SERIES.items() if k != "url_template"},
        *[{k: v for k, v in SERIES.items() if k != lost} for lost in ("path", "place")],
        *[dict(SERIES, path={k: v for k, v in SERIES["path"].items() if k != lost})
          for lost in ("series", "templates", "delimiter")],
        dict(SERIES, path=dict(SERIES["path"], series="WORD")), dict(SERIES, place=3),
        dict(SERIES, path=dict(SERIES["path"], templates=["{term}"] * 4)),
    ],
)
def test_bad_url_templates(spark, config):
    with pytest.raises(UrlError):
        UrlTemplate.from_config(config).column(F.col("d"), TOPICS)


def test_search_plan_skips_impossible_urls(spark):
    searches = spark.sql("""SELECT 1 id, array(named_struct('topic', 'a', 'terms', array('x')),
      named_struct('topic', 'b', 'terms', CAST(NULL AS array<string>))) search_data""")
    providers = {n: UrlTemplate.from_config({"url_template": f"u/{{{n}}}"}) for n in ("a", "b")}
    found = search_plan(searches, providers, ["a", "b"]).collect()
    assert [(r["provider"], r["url"]) for r in found] == [("a", "u/x")]


def test_provider_definitions():
    config = {"url": "u", "items": {"tag_name": "li"}, "content": {}, "delay": {"mu": 1, "odd": 2}, "odd": 1}
    site = Provider.multi("d", config)
    assert (site.pages, site.page_size, site.freshness_days, site.ignored) == (1, None, 30.0, ("odd",))
    assert site.dwell.mu == 1 and site.extract_sources
    paged = Provider.multi("d", dict(config, pagination={"page_size": 5, "next_page_url": {"id": "n"}}))
    assert (paged.pages, paged.page_size) == (10, 5)
    for ways in ({}, {"next_page_url": {"id": "n"}, "next_page_click": {"id": "n"}}):
        with pytest.raises(ValueError):
            Provider.multi("d", dict(config, pagination={"page_size": 5, **ways}))
    assert Provider.source("d", {"content": {}}).freshness_days == 365.0


def test_terms_of_all_topics_in_search_urls(spark, tmp_path):
    """Every set topic's terms are in the address, those of the organisation too."""
    from gleanery.queries.flows import build_urls_terms

    customers = [(1, "Ann Lee", 0, 9000.0, "BUILDING"), (2, "Bo", 0, 10.0, "MACHINERY")]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "New Land")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = dict(build_urls_terms(spark, str(tmp_path)).collect())
    place = "New%20Land+alt:N/0?all="
    assert found[1] == f"https://c.example/Building/places/{place}!body:Building!~and~!body:Ann%20Lee%20%26%20Co!~and~!body:New%20Land~or~body:N/0!"
    assert found[2] == f"https://c.example/Machinery/places/{place}!body:Machinery!~and~!body:New%20Land~or~body:N/0!"

"""Commits over several stores, streamed extraction that is killed, and statuses that age."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions.records import Field, Model
from gleanery.operators.html import with_nodes
from gleanery.plans.extraction import Provider
from gleanery.sources.commits import StoreGroup
from gleanery.streaming.ageing import Ageing, Held, aged_statuses
from gleanery.streaming.extraction import ARRIVING, extracted, extraction_stores, stream_extraction

MODEL = Model("Entry", tuple(Field(n) for n in ("source_url", "title", "publisher")))
SITES = {
    name: Provider.multi(name, {
        "url": "https://x.example/", "cache_version": version, "items": {"is_multiple": True, "tag_name": tag},
        "pagination": {"pages": 5, "page_size": 3, "next_page_url": {"tag_name": "a", "attribute": "href"}},
        "content": {"source_url": {"tag_name": "a", "attribute": "href"}, "title": {"tag_name": "a", "getattr": "text"}, "publisher": name},
    })
    for name, version, tag in (("one", "v1", "li"), ("two", None, "p"))
}


def pages(spark):
    rows = []
    for search in range(3):
        for number in range(1, 7):
            links = "".join(f'<li><a href="/i/{search * 2 + number + k}">T{number}.{k}</a></li>' for k in range(3))
            html = links if number < 4 else "<li><b>none</b></li>" if number == 4 else "<div></div>"
            for provider in ("one", "two", "gone"):
                rows.append((search, provider, number, f"https://x.example/{search}/{number}", html, f"2024-01-{number:02}"))
    named = "search_key long, provider string, page int, url string, html string, day string"
    return spark.createDataFrame(rows, named).select(
        "search_key", "provider", "page", "url", "html", F.col("day").cast("timestamp_ntz").alias("fetched_at")
    )


def content_of(stores):
    found = {}
    for name in stores.stores:
        frame = stores.read(name)
        found[name] = sorted(map(str, frame.select(sorted(frame.columns)).collect()))
    return found


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    """What one batch of all pages stores."""
    stores = extraction_stores(spark, str(tmp_path_factory.mktemp("batch")), MODEL)
    assert stores.commit(extracted(pages(spark), SITES, MODEL), 0)
    return content_of(stores)


def test_batch_has_something_of_each_kind(expected):
    assert len(expected["content"]) == 9
    assert sorted({r.split("status=")[1].split(",")[0].rstrip(")") for r in expected["info"]}) == ["2", "5"]
    assert all("gone" not in r for rows in expected.values() for r in rows)


@pytest.mark.parametrize("at", ["content", "provider_index", "info", "mark"])
def test_stream_killed_between_writes(spark, tmp_path, monkeypatch, expected, at):
    """The second batch dies after some stores are written; readers see the first only, and a restart makes it whole."""
    arriving, progress = str(tmp_path / "arriving"), str(tmp_path / "progress")
    rows = pages(spark)
    assert dict(rows.dtypes) == dict(spark.createDataFrame([], ARRIVING).dtypes)
    rows.repartition(4, "url").write.parquet(arriving)
    stores = extraction_stores(spark, str(tmp_path / "stores"), MODEL)
    calls = {"n": 0}

    def dies(real, name):
        def write(*args):
            if calls["n"] >= 1 and calls["n"] < 2 and (name == at):
                calls["n"] += 1
                raise RuntimeError("killed")
            if name == "mark":
                calls["n"] += calls["n"] == 0
            return real(*args)
        return write

    for name, store in stores.stores.items():
        monkeypatch.setattr(store, "append", dies(store.append, name))
    monkeypatch.setattr(stores, "_mark", dies(stores._mark, "mark"))
    stream = stream_extraction(spark, arriving, SITES, MODEL, stores, progress, 1)
    with pytest.raises(Exception, match="killed"):
        stream.awaitTermination()
    assert len(stores.batches()) == 1
    stream_extraction(spark, arriving, SITES, MODEL, stores, progress, 1).awaitTermination()
    assert len(stores.batches()) >= 2
    assert content_of(stores) == expected
    stores.fold()
    assert len(stores.batches()) == 1 and content_of(stores) == expected


def test_commits(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string, at int").schema
    group = StoreGroup(spark, str(tmp_path / "g"), {"a": (["k"], ["at"], schema), "b": (["k"], ["at"], schema)})
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert group.batches() == [] and group.read("a").count() == 0
    assert group.commit({"a": frame((1, "x", 1)), "b": frame()}, 0)
    assert not group.commit({"a": frame((1, "other", 9)), "b": frame()}, 0)
    # Written but not marked: not there.
    group.stores["a"].append(frame((2, "lost", 1)), 1, "direct")
    assert [tuple(r) for r in group.read("a").collect()] == [(1, "x", 1)]
    with pytest.raises(ValueError):
        group.commit({"a": frame()}, 2)
    assert group.commit({"a": frame((1, None, 3), (2, "y", 3)), "b": frame((5, "z", 1))}, 1)
    group.fold()
    assert sorted(tuple(r) for r in group.read("a").collect()) == [(1, "x", 3), (2, "y", 3)]
    assert not group.commit({"a": frame((1, "late", 9)), "b": frame()}, 0), "a replaced batch stays known"


HOUR = 3_600_000_000
RULES = Ageing(patience=10 * HOUR, retry=4 * HOUR, reopen=6 * HOUR)


@pytest.mark.parametrize("writes, expected", [
    ([(0, 3)], [(0, 3, None, "accepted"), (10, 1, 3, "aged")]),
    ([(0, 4)], [(0, 4, None, "refused")]),
    ([(0, 3, True)], [(0, 3, None, "accepted"), (10, 2, 3, "aged")]),
    # A repeated start renews the time and keeps that pages were read; a deadline comes before a write of its moment.
    ([(0, 3, True), (9, 3)], [(0, 3, None, "accepted"), (9, 3, 3, "accepted"), (19, 2, 3, "aged")]),
    ([(0, 3), (10, 4)], [(0, 3, None, "accepted"), (10, 1, 3, "aged"), (10, 4, 1, "refused")]),
    ([(0, 3), (9, 4), (30, 5)], [(0, 3, None, "accepted"), (9, 4, 3, "accepted"), (30, 5, 4, "accepted")]),
    # Starts wait after a failure, and finished work before it re-opens.
    ([(0, 3), (1, 1), (4, 3), (5, 3), (6, 2)],
     [(0, 3, None, "accepted"), (1, 1, 3, "accepted"), (4, 3, 1, "refused"), (5, 3, 1, "accepted"), (6, 2, 3, "accepted")]),
    ([(0, 3), (1, 4), (2, 5), (7, 4), (8, 4), (9, 3)],
     [(0, 3, None, "accepted"), (1, 4, 3, "accepted"), (2, 5, 4, "accepted"), (7, 4, 5, "refused"), (8, 4, 5, "accepted"), (9, 3, 4, "refused")]),
])
def test_rules_of_ageing(writes, expected):
    rows = [(w[0] * HOUR, n, w[1], len(w) > 2) for n, w in enumerate(writes)]
    _, found = RULES.walk(Held(), rows, 100 * HOUR)
    assert [(ts // HOUR, status, before, kind) for _, ts, status, before, kind in found] == expected
    # Cut anywhere, and with time passing at the cut, the outcome is the same.
    for cut in range(len(rows)):
        held, first = RULES.walk(Held(), rows[:cut], rows[cut][0] - 1)
        _, rest = RULES.walk(held, rows[cut:], 100 * HOUR)
        assert first + rest == found


def test_ageing_depends_on_no_batch(spark, tmp_path):
    schema = "search bigint, provider string, event_id bigint, at bigint, status int, answered boolean, text string"
    rows = []
    for n in range(240):
        status = [3, 4, 5, 4, None, 3, 1, 3, 2, 9][n * 7 % 10]
        rows.append((None if n % 9 == 0 else n % 4, None if n % 11 == 0 else f"p{n % 3}", n, (n + 1) * HOUR // 2, status, [True, False, None][n % 3], "x"))
    rows += rows[-1:]

    def run(name, parts):
        arriving, out, progress = (str(tmp_path / f"{name}-{k}") for k in ("in", "out", "progress"))
        for part in [*parts, [(None, None, None, 2000 * HOUR, None, None, None)]]:
            logged = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("at")).drop("at")
            logged.write.mode("append").parquet(arriving)
            stream = aged_statuses(spark.readStream.schema(logged.schema).parquet(arriving), ["search", "provider"], RULES, "3 hours")
            options = {"path": out, "checkpointLocation": progress}
            stream.writeStream.format("parquet").options(**options).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(str, spark.read.parquet(out).collect()))

    whole = run("whole", [rows])
    # Up to 2.5 hours out of order, in four parts, each by a stream started anew.
    late = sorted(rows, key=lambda r: r[3] + (r[2] % 6) * HOUR // 2)
    assert run("parts", [late[k:k + 61] for k in range(0, len(late), 61)]) == whole
    expected, groups = [], {}
    for search, provider, n, at, status, answered, _ in rows:
        if status is not None:
            groups.setdefault((search, provider), []).append((at, n, status, bool(answered)))
    for writes in groups.values():
        expected += RULES.walk(Held(), sorted(writes), 1997 * HOUR)[1]
    assert len(whole) == len(expected) and sum("aged" in r for r in whole) == sum(f[4] == "aged" for f in expected) > 0


def test_ageing_keeps_many_keys_in_one_state(spark, tmp_path):
    """Keys share states, so that a stream's cost does not go by keys; their times and ids stay exact."""
    first = 2**60 + 1
    rows = [(None if n % 40 == 39 else n % 40, f'k"{n % 3}\\', first + n, (n + 1) * HOUR // 4, [3, 4, 1][n // 120], n % 2 == 0) for n in range(360)]
    rows.append((None, None, None, 2000 * HOUR, None, None))
    schema = "search bigint, provider string, event_id bigint, at bigint, status int, answered boolean"
    logged = spark.createDataFrame(rows, schema).withColumn("since", F.timestamp_micros(F.col("search") + 1)).withColumn("ts", F.timestamp_micros("at"))
    arriving, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    logged = logged.drop("at")
    logged.write.parquet(arriving)
    stream = aged_statuses(spark.readStream.schema(logged.schema).parquet(arriving), ["search", "since", "provider"], RULES, "3 hours", buckets=5)
    options = {"path": out, "checkpointLocation": progress}
    query = stream.writeStream.format("parquet").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert 0 < held <= 5
    found = spark.read.parquet(out).select("search", F.unix_micros("since"), "provider", "event_id", F.unix_micros("ts"), "status", "previous", "kind")
    expected, groups = [], {}
    for search, provider, n, at, status, answered in rows[:-1]:
        groups.setdefault((search, None if search is None else search + 1, provider), []).append((at, n, status, answered))
    for key, writes in groups.items():
        expected += [(*key, *step) for step in RULES.walk(Held(), sorted(writes), 1997 * HOUR)[1]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_pages_beyond_the_last_are_not_parsed(spark, tmp_path, monkeypatch):
    """What no item or visit can come of is left out before the markup is read."""
    from gleanery.streaming import extraction

    read = []
    monkeypatch.setattr(extraction, "with_nodes", lambda rows: read.append(rows) or with_nodes(rows))
    rows = extracted(pages(spark).unionByName(pages(spark).limit(1).withColumn("page", F.lit(None).cast("int"))), SITES, MODEL)
    assert {r["page"] for r in read[0].select("page").distinct().collect()} == {1, 2, 3, 4, 5}
    assert {r["page"] for r in rows["content"].select("page").distinct().collect()} == {1, 2, 3}

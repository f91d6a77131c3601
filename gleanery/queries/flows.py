"""Storage, status, search, ordering, routing and incremental queries."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from gleanery.functions import phrases
from gleanery.functions.records import AGENT
from gleanery.operators import assemble, cardinality, crawl, pointers, status
from gleanery.plans.extraction import KNOWN_KEYS, unknown_keys
from gleanery.plans.search import UrlTemplate, search_plan
from gleanery.queries.common import (
    HOST_SQL, HREF_SQL, INFO_SQL, LABEL_SQL, LINKS_SQL, LISTED_SQL, NOW, REUSE_SQL, STATUS_SQL, Registry, big,
    listing_pages, page_hosts, status_log, table, work_table,
)
from gleanery.session import scratch_path
from gleanery.sources import store, tables

R = Registry()
C = F.col


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- sources and sinks ---------------------------------------------------------


def _site_definitions(spark, sf):
    """One definition per host of the page table, as a catalog would hold them."""
    hosts = page_hosts(spark, sf).select(
        F.replace("domain", F.lit("."), F.lit("_")).alias("directory")
    ).distinct()
    text = tables.definition_column(
        is_enabled=~C("directory").startswith("spam"),
        cache_version=F.concat(F.lit("v-"), F.substring("directory", 1, 3)),
        freshness_threshold=F.length("directory"),
        extract_sources=C("directory").endswith("_org"),
        color=F.when(C("directory").startswith("www"), F.lit("unread")),
    )
    broken = C("directory").startswith("m_")
    return hosts.select("directory", F.when(broken, F.lit('{"url": ')).otherwise(text).alias("value"))


def _catalog(spark, sf):
    root = scratch_path(spark, "catalog")
    definitions = _site_definitions(spark, sf)
    # One small file per site, as site definitions are kept.
    definitions.repartition("directory").write.partitionBy("directory").text(root)
    return tables.read_definitions(spark, root, "*.txt").withColumn(
        "directory", F.regexp_replace("directory", "^directory=", "")
    )


HOSTS_SQL = f"hosts AS (SELECT DISTINCT replace({HOST_SQL}, '.', '_') AS directory FROM pages)"


@R.add("provider_catalog", f"""WITH {HOSTS_SQL}
SELECT directory, 'v-' || left(directory, 3) AS cache_version, length(directory)::DOUBLE AS freshness_days,
  directory LIKE '%\\_org' ESCAPE '\\' AS extract_sources
FROM hosts WHERE NOT starts_with(directory, 'm_') AND NOT starts_with(directory, 'spam')""")
def provider_catalog(spark, sf):
    return tables.enabled_definitions(_catalog(spark, sf)).select(
        "directory", "cache_version", "freshness_days", "extract_sources"
    )


@R.add("unknown_keys", f"""WITH {HOSTS_SQL} SELECT directory, 'color' AS setting FROM hosts
WHERE starts_with(directory, 'www')""")
def unknown_keys_query(spark, sf):
    settings = _site_definitions(spark, sf).select(
        "directory", F.json_object_keys("value").alias("given")
    )
    extra = unknown_keys(C("given"), list(KNOWN_KEYS))
    return settings.select("directory", F.explode(extra).alias("setting"))


SUPPLIER_SCHEMA = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


@R.add("csv_roundtrip", """SELECT s_suppkey, s_name || ' | "' || s_suppkey || '"' AS s_name, s_nationkey,
  s_acctbal FROM supplier""")
def csv_roundtrip(spark, sf):
    named = F.concat("s_name", F.lit(' | "'), "s_suppkey", F.lit('"'))
    path = scratch_path(spark, "suppliers")
    tables.write_table(table(spark, sf, "supplier").withColumn("s_name", named), path)
    return tables.read_table(spark, path, SUPPLIER_SCHEMA)


@R.add("default_when_missing", """SELECT 'https://a.example/' || s_suppkey AS source_url,
  'Agent ' || s_name AS user_agent, 'Chrome' AS browser, 'stored' AS origin FROM supplier
UNION ALL SELECT 'https://developers.whatismybrowser.com/useragents/parse/627832-chrome-windows-blink',
  'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/60.0.3112.113 Safari/537.36',
  'Chrome', 'default'""")
def default_when_missing(spark, sf):
    schema = tables.public_schema(AGENT)
    path = scratch_path(spark, "agents")
    agents = table(spark, sf, "supplier").select(
        F.concat(F.lit("https://a.example/"), "s_suppkey").alias("source_url"),
        big("s_suppkey").cast("int").alias("rank"),
        F.concat(F.lit("Agent "), "s_name").alias("user_agent"),
        F.lit("Chrome").alias("browser"),
        *[F.lit(None).cast("string").alias(n) for n in (
            "browser_version", "operating_system", "hardware_type", "popularity")],
    )
    tables.write_table(agents, path)
    read = lambda p, origin: tables.read_or_default(
        spark, p, schema, tables.DEFAULT_AGENT
    ).select("source_url", "user_agent", "browser", F.lit(origin).alias("origin"))
    return read(path, "stored").unionByName(read(path + "-absent", "default"))


def _event_records(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id",
        "event_type",
        F.when(C("value") >= 20, C("value")).alias("value"),
        F.when(C("event_type") != "error", C("props")).alias("props"),
    )


@R.add("upsert_partial", """SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type,
  last(value ORDER BY ts, event_id) FILTER (WHERE value >= 20) AS value,
  last(props ORDER BY ts, event_id) FILTER (WHERE event_type <> 'error') AS props,
  last(event_id ORDER BY ts, event_id) AS event_id, 'v7' AS cache_version,
  '2024-01-31T00:00:00' AS last_extracted FROM events GROUP BY 1""")
def upsert_partial(spark, sf):
    events = _event_records(spark, sf)
    middle = F.lit("2024-01-15").cast("timestamp")
    stored = store.merge_fields(events.filter(C("ts") < middle), ["user_id"], ["ts", "event_id"])
    merged = store.upsert(stored, events.filter(C("ts") >= middle), ["user_id"], ["ts", "event_id"])
    stamped = store.prepare_content(merged.withColumn("rank", F.lit(1)), F.lit("v7"), _now())
    return stamped.select(
        "user_id", "event_type", "value", "props", "event_id", C("_cache_version").alias("cache_version"),
        F.date_format("_last_extracted", "yyyy-MM-dd'T'HH:mm:ss").alias("last_extracted"),
    )


@R.add("content_lookup", """SELECT event_id, event_id AS doc_id, n_chars, source, lang
FROM events LEFT JOIN documents ON doc_id = event_id""")
def content_lookup(spark, sf):
    """Every event looks for the document of its number; there are more events than documents."""
    keys = table(spark, sf, "events").select("event_id", C("event_id").alias("doc_id"))
    content = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    return store.lookup(keys, content, "doc_id")


def _ranked_results(spark, sf):
    return status_log(spark, sf).select(
        "search_key", "provider", (C("search_key") + C("event_id") % 3).alias("doc_id"),
        F.floor("value").cast("bigint").alias("rank"), "ts", "event_id",
    )


RANKED_SQL = STATUS_SQL + """,
results AS (SELECT search_key, provider, search_key + event_id % 3 AS doc_id, CAST(floor(value) AS BIGINT) AS rank,
  ts, event_id FROM log)"""


@R.add("ranked_index", f"""WITH {RANKED_SQL}
SELECT search_key, provider, doc_id, last(rank ORDER BY ts, event_id) AS rank FROM results GROUP BY ALL
UNION ALL SELECT search_key, NULL, doc_id, last(rank ORDER BY ts, event_id) FROM results GROUP BY ALL""")
def ranked_index(spark, sf):
    order = ["ts", "event_id"]
    per_provider = store.rank_index(
        _ranked_results(spark, sf), ["search_key", "provider"], "doc_id", "rank", order
    )
    # The search-wide index follows from the smaller per-provider one.
    overall = store.rank_index(per_provider, ["search_key"], "doc_id", "rank", order)
    overall = overall.withColumn("provider", F.lit(None).cast("string"))
    return per_provider.unionByName(overall).select("search_key", "provider", "doc_id", "rank")


@R.add("ranked_read", f"""WITH {RANKED_SQL},
idx AS (SELECT search_key, doc_id, last(rank ORDER BY ts, event_id) AS rank FROM results GROUP BY ALL)
SELECT search_key, doc_id, rank, source, n_chars FROM idx LEFT JOIN documents USING (doc_id)""")
def ranked_read(spark, sf):
    index = store.rank_index(
        _ranked_results(spark, sf), ["search_key"], "doc_id", "rank", ["ts", "event_id"]
    ).select("search_key", "doc_id", "rank")
    content = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return store.ranked_content(index, content, "doc_id", "rank")


@R.add("content_map", f"""WITH {RANKED_SQL},
idx AS (SELECT search_key, doc_id, last(rank ORDER BY ts, event_id) AS rank FROM results GROUP BY ALL)
SELECT search_key, doc_id, rank, source, source IS NULL AS missing
FROM idx LEFT JOIN (SELECT * FROM documents WHERE doc_id % 10 > 0) USING (doc_id)""")
def content_map(spark, sf):
    """Index members with their content, and those whose content was never stored."""
    index = store.rank_index(
        _ranked_results(spark, sf), ["search_key"], "doc_id", "rank", ["ts", "event_id"]
    ).select("search_key", "doc_id", "rank")
    stored = table(spark, sf, "documents").filter("doc_id % 10 > 0").select("doc_id", "source")
    present, missing = store.content_map(index, stored, "doc_id")
    return present.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumn("source", F.lit(None).cast("string")).withColumn("missing", F.lit(True))
    )


def _info(spark, sf):
    writes = store.info_updates(status_log(spark, sf), "status", "ts", "version")
    return store.merge_fields(
        writes.select("search_key", "provider", "status", "last_extracted", "cache_version", "ts",
                      "event_id"),
        ["search_key", "provider"], ["ts", "event_id"],
    )


@R.add("info_upsert", f"""WITH {INFO_SQL}
SELECT search_key, provider, {LABEL_SQL} AS status,
  strftime(last_extracted, '%Y-%m-%dT%H:%M:%S.%f') AS last_extracted, cache_version FROM info""")
def info_upsert(spark, sf):
    stored = _info(spark, sf).select(
        "search_key", "provider",
        store.info_to_hash(C("status"), C("last_extracted"), C("cache_version")).alias("hash"),
    )
    back = stored.select("search_key", "provider", *store.info_from_hash(C("hash")))
    return back.select(
        "search_key", "provider", status.STATUS.label_of(C("status")).alias("status"),
        F.date_format("last_extracted", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_extracted"),
        "cache_version",
    )


def _payloads(spark, sf):
    """A search payload per customer: segment as problem, nation as place, region above it."""
    customers = work_table(spark, sf, "customer")
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey")
    )
    joined = customers.join(nations, C("c_nationkey") == C("n_nationkey"))
    text = lambda template, *cols: F.format_string(template, *cols)
    community = text("/communities/%s", "c_custkey")
    problem = F.concat(F.lit("/problems/"), F.lower("c_mktsegment"))
    geo, parent = text("/geos/%s", "n_nationkey"), text("/regions/%s", "r_regionkey")
    abbrev = F.when(C("n_nationkey") < 10, F.concat(F.lit("N"), "n_nationkey"))
    levels = F.when(
        C("r_regionkey") == 0, F.lit('{"country":"x","subdivision1":"y"}')
    ).otherwise(F.lit('{"locality":"x"}'))
    obj = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    json = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    body = obj(
        "{", json(community), ':{"name":', json(C("c_name")), ',"problem":', json(problem),
        ',"org":null,"geo":', json(geo), "},",
        json(problem), ':{"name":', json(C("c_mktsegment")), "},",
        json(geo), ':{"name":', json(C("n_name")), ',"abbrev":', json(abbrev), ',"levels":',
        levels, ',"path_parent":', json(parent), "},",
        json(parent), ':{"name":', json(C("r_name")), ',"abbrev":', json(F.substring("r_name", 1, 2)), "},",
        '"root":', json(community), "}",
    )
    return joined.select(C("c_custkey").alias("payload_id"), body.alias("body"))


PLACES_SQL = """places AS (SELECT *, '/communities/' || c_custkey AS community,
    '/problems/' || lower(c_mktsegment) AS problem, '/geos/' || n_nationkey AS geo,
    '/regions/' || r_regionkey AS parent, CASE WHEN n_nationkey < 10 THEN 'N' || n_nationkey END AS abbrev
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@R.add("payload_entries", f"""WITH {PLACES_SQL}
SELECT c_custkey AS payload_id, unnest(range(5)) AS pos,
  unnest([community, problem, geo, parent, 'root']) AS path,
  unnest([c_name, c_mktsegment, n_name, r_name, NULL]) AS name,
  unnest([NULL, NULL, NULL, NULL, community]) AS pointer FROM places""")
def payload_entries(spark, sf):
    entries = tables.payload_entries(_payloads(spark, sf))
    return entries.select(
        "payload_id", big("pos").alias("pos"), "path",
        F.get_json_object("obj", "$.name").alias("name"),
        F.when(~C("obj").startswith("{"), C("obj")).alias("pointer"),
    )


def _terms(topic):
    entry = F.get(F.filter("search_data", lambda t: t["topic"] == topic), F.lit(0))
    return F.array_join(entry["terms"], "; ").alias(topic)


GEO_SQL = """CASE WHEN r_regionkey = 0 THEN n_name || coalesce('; ' || abbrev, '')
  ELSE n_name || ', ' || r_name || '; ' || n_name || ', ' || left(r_name, 2)
    || coalesce('; ' || abbrev || ', ' || r_name || '; ' || abbrev || ', ' || left(r_name, 2), '') END"""


@R.add("search_terms", f"""WITH {PLACES_SQL}
SELECT c_custkey AS payload_id, c_mktsegment AS problem, NULL::VARCHAR AS org, {GEO_SQL} AS geo FROM places""")
def search_terms(spark, sf):
    found = pointers.search_terms(_payloads(spark, sf))
    return found.select("payload_id", _terms("problem"), _terms("org"), _terms("geo"))


@R.add("resolve_pointers", f"""WITH {PLACES_SQL}
SELECT c_custkey AS payload_id, community AS path, 'geo' AS field, 0::BIGINT AS pos, n_name AS name FROM places
UNION ALL SELECT c_custkey, geo, 'path_parent', 0, r_name FROM places
UNION ALL SELECT c_custkey, community, 'nowhere', 0, NULL FROM places
UNION ALL SELECT c_custkey, 'list', 'members', unnest([0, 1]), unnest([c_mktsegment, n_name]) FROM places""")
def resolve_pointers(spark, sf):
    objects = tables.payload_entries(_payloads(spark, sf)).filter("path <> 'root'").select(
        "payload_id", "path", "obj"
    )

    # Which objects each field is followed from.
    bases = {"geo": "/communities/", "path_parent": "/geos/", "nowhere": "/communities/"}
    from_base = reduce(or_, [(C("field") == f) & C("path").startswith(p) for f, p in bases.items()])
    followed = pointers.resolve_pointers(objects, list(bases)).filter(from_base).select(
        "payload_id", "path", "field", F.lit(0).cast("bigint").alias("pos"),
        F.get_json_object("related", "$.name").alias("name"),
    )
    # A list of pointers: the payload's problem and place, and one that leads nowhere.
    lists = objects.filter("path like '/geos/%' or path like '/problems/%'").groupBy("payload_id").agg(
        F.min(F.when(C("path").startswith("/problems"), C("path"))).alias("p"),
        F.min(F.when(C("path").startswith("/geos"), C("path"))).alias("g"),
    ).select(
        "payload_id", F.lit("list").alias("path"),
        F.to_json(F.struct(F.array("p", "g", F.lit("/none")).alias("members"))).alias("obj"),
    )
    members = pointers.resolve_pointer_list(objects.unionByName(lists), "members")
    named = members.select(
        "payload_id", "path", F.lit("members").alias("field"), big("pos").alias("pos"),
        F.get_json_object("related", "$.name").alias("name"),
    )
    return followed.unionByName(named)


@R.add("geo_terms", """SELECT n_nationkey, unnest(CASE WHEN r_regionkey = 0 THEN [n_name, 'N' || n_nationkey]
  ELSE [n_name || ', ' || r_name, n_name || ', ' || left(r_name, 2), 'N' || n_nationkey || ', ' || r_name,
        'N' || n_nationkey || ', ' || left(r_name, 2)] END) AS term
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def geo_terms(spark, sf):
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey")
    )
    terms = pointers.geo_terms(
        pointers.names_of(C("n_name"), F.concat(F.lit("N"), "n_nationkey")),
        pointers.names_of(C("r_name"), F.substring("r_name", 1, 2)),
        F.when(C("r_regionkey") == 0, F.lit("country")).otherwise(F.lit("locality")),
    )
    return places.select("n_nationkey", F.explode(terms).alias("term"))


# --- search URLs ---------------------------------------------------------------

TOPICS = ["problem", "org", "geo"]
SITE_A = UrlTemplate.from_config({"url_template": "https://a.example/find/{problem}/1"})
SITE_B = UrlTemplate.from_config({
    "url_template": "https://b.example/{path}?again={path}",
    "path": {"series": "TOPIC", "templates": ["p-{term}", "by/{term}", "{place}"], "delimiter": "/"},
    "place": "in_{term}_{index}",
})
SITE_C = UrlTemplate.from_config({
    "url_template": "https://c.example/{problem}/places/{places}",
    "places": {"series": "TERM", "templates": ["{geo}", "alt:{geo}"], "delimiter": "+"},
})
# The same places, and every term of every topic: a term series within a topic series.
SITE_TERMS = UrlTemplate.from_config({
    "url_template": "https://c.example/{problem}/places/{places}?all={every}",
    "places": {"series": "TERM", "templates": ["{geo}", "alt:{geo}"], "delimiter": "+"},
    "every": {"series": "TOPIC", "templates": ["!{any}!"], "delimiter": "~and~"},
    "any": {"series": "TERM", "templates": ["body:{term}"], "delimiter": "~or~"},
})


def _searches(spark, sf):
    """One search per customer; some leave the organisation unset."""
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")
    )
    org = F.when(C("c_acctbal") > 5000, F.array(F.concat("c_name", F.lit(" & Co"))))
    data = F.array(
        pointers.topic("problem", F.array(F.initcap("c_mktsegment"))),
        pointers.topic("org", org),
        pointers.topic("geo", F.array(F.col("n_name"), F.concat(F.lit("N/"), "n_nationkey"))),
    )
    return customers.select("c_custkey", data.alias("search_data"))


QUOTE = "replace(url_encode({}), '%2F', '/')"
PROBLEM_SQL = "upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:])"
ORG_SQL = QUOTE.format("CASE WHEN c_acctbal > 5000 THEN c_name || ' & Co' END")
FROM_SQL = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
URL_A_SQL = f"'https://a.example/find/' || {QUOTE.format(PROBLEM_SQL)} || '/1'"
PATH_B_SQL = f"""'p-' || {QUOTE.format(PROBLEM_SQL)} || '/'
  || coalesce('by/' || {ORG_SQL} || '/in_' || {QUOTE.format('n_name')} || '_3', 'in_' || {QUOTE.format('n_name')} || '_2')"""
URL_B_SQL = f"'https://b.example/' || {PATH_B_SQL} || '?again=' || {PATH_B_SQL}"
URL_C_SQL = f"""'https://c.example/' || {QUOTE.format(PROBLEM_SQL)} || '/places/' || {QUOTE.format('n_name')}
  || '+alt:N/' || n_nationkey"""
URL_TERMS_SQL = f"""{URL_C_SQL} || '?all=!body:' || {QUOTE.format(PROBLEM_SQL)} || '!~and~'
  || coalesce('!body:' || {ORG_SQL} || '!~and~', '') || '!body:' || {QUOTE.format('n_name')} || '~or~body:N/' || n_nationkey || '!'"""


def _urls(spark, sf, site):
    return _searches(spark, sf).select("c_custkey", site.column(C("search_data"), TOPICS).alias("url"))


@R.add("build_urls", f"SELECT c_custkey, {URL_A_SQL} AS url {FROM_SQL}")
def build_urls(spark, sf):
    return _urls(spark, sf, SITE_A)


@R.add("build_urls_topics", f"SELECT c_custkey, {URL_B_SQL} AS url {FROM_SQL}")
def build_urls_topics(spark, sf):
    return _urls(spark, sf, SITE_B)


@R.add("build_urls_terms", f"SELECT c_custkey, {URL_TERMS_SQL} AS url {FROM_SQL}")
def build_urls_terms(spark, sf):
    return _urls(spark, sf, SITE_TERMS)


@R.add("search_plan", f"""SELECT c_custkey, 'a' AS provider, {URL_A_SQL} AS url {FROM_SQL}
UNION ALL SELECT c_custkey, 'b', {URL_B_SQL} {FROM_SQL}
UNION ALL SELECT c_custkey, 'c', {URL_C_SQL} {FROM_SQL}
UNION ALL SELECT c_custkey, 'd', 'https://d.example/all' {FROM_SQL}
UNION ALL SELECT c_custkey, 'e', 'https://e.example/' || {ORG_SQL} {FROM_SQL} WHERE c_acctbal > 5000""")
def search_plan_query(spark, sf):
    providers = {
        "a": SITE_A, "b": SITE_B, "c": SITE_C,
        "d": UrlTemplate.from_config("https://d.example/all"),
        "e": UrlTemplate.from_config("https://e.example/{org}"),
    }
    return search_plan(_searches(spark, sf), providers, TOPICS).drop("search_data")


# --- status --------------------------------------------------------------------


def _reuse():
    return status.reusable(C("status"), C("last_extracted"), C("cache_version"), _now(), 15, F.lit("v1"))


@R.add("freshness_flag", f"""WITH {INFO_SQL} SELECT search_key, provider, {REUSE_SQL} AS reusable,
  coalesce(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_extracted)) / 86400000000.0) < 365
    AND cache_version IS NOT DISTINCT FROM 'v2', false) AS reusable_source FROM info""")
def freshness_flag(spark, sf):
    source = status.reusable_source(C("last_extracted"), C("cache_version"), _now(), F.lit("v2"))
    return _info(spark, sf).select(
        "search_key", "provider", _reuse().alias("reusable"), source.alias("reusable_source")
    )


PLAN_SQL = """plan AS (SELECT search_key, 'p' || i AS provider
  FROM (SELECT DISTINCT search_key FROM log), (SELECT unnest(range(10)) AS i))"""


def _plan(spark, sf):
    """Every search at ten providers, two of which no search has seen yet."""
    searches = table(spark, sf, "events").select(C("user_id").alias("search_key")).distinct()
    providers = F.array(*[F.lit(f"p{i}") for i in range(10)])
    return searches.select("search_key", F.explode(providers).alias("provider"))


@R.add("stale_work", f"""WITH {INFO_SQL}, {PLAN_SQL}
SELECT search_key, provider FROM plan WHERE (search_key, provider) NOT IN
  (SELECT (search_key, provider) FROM info WHERE {REUSE_SQL})""")
def stale_work(spark, sf):
    return status.outstanding(
        _plan(spark, sf), _info(spark, sf), ["search_key", "provider"], _reuse()
    )


@R.add("provider_info", f"""WITH {INFO_SQL}, {PLAN_SQL}
SELECT search_key, provider, status, cache_version FROM plan LEFT JOIN info USING (search_key, provider)""")
def provider_info(spark, sf):
    return status.provider_info(
        _plan(spark, sf), _info(spark, sf), ["search_key", "provider"]
    ).select("search_key", "provider", "status", "cache_version")


ROLL_SQL = "CASE WHEN min(s) = 5 THEN 5 WHEN max(s) >= 4 THEN 4 ELSE max(s) END"


@R.add("status_rollup", f"""WITH {INFO_SQL} SELECT search_key, {ROLL_SQL} AS status
FROM (SELECT search_key, CASE WHEN cache_version = 'v2' THEN status END AS s FROM info) GROUP BY 1""")
def status_rollup(spark, sf):
    rows = _info(spark, sf).select(
        "search_key", F.when(C("cache_version") == "v2", C("status")).alias("status")
    )
    return status.roll_up(rows, ["search_key"])


@R.add("overall_status", f"""WITH {INFO_SQL}, {PLAN_SQL}
SELECT search_key, CASE WHEN bool_and(ok OR p IS NULL) THEN 5
  WHEN max(s) IS NULL THEN 3 WHEN min(s) = 5 OR max(s) >= 4 THEN 4 ELSE max(s) END AS status
FROM (SELECT k.search_key, p.provider AS p, status AS s, {REUSE_SQL} AS ok
      FROM (SELECT DISTINCT search_key FROM log) k
      LEFT JOIN plan p ON p.search_key = k.search_key AND (k.search_key % 9 * 10 + p.provider[2:]::INT) % 9 = 1
      LEFT JOIN info i ON i.search_key = p.search_key AND i.provider = p.provider) GROUP BY 1""")
def overall_status(spark, sf):
    """Each search with its own few active providers; some searches have none."""
    keys = ["search_key", "provider"]
    number = F.substring("provider", 2, 1).cast("int")
    active = _plan(spark, sf).filter((C("search_key") % 9 * 10 + number) % 9 == 1)
    searches = table(spark, sf, "events").select(C("user_id").alias("search_key")).distinct()
    planned = searches.join(active, "search_key", "left")
    known = status.provider_info(planned, _info(spark, sf), keys)
    return status.overall_status(known, ["search_key"], _reuse())


@R.add("search_answers", f"""WITH {INFO_SQL}, {PLAN_SQL},
results AS (SELECT search_key, search_key + event_id % 3 AS doc_id, CAST(floor(value) AS BIGINT) AS rank, ts, event_id FROM log),
idx AS (SELECT search_key, doc_id, last(rank ORDER BY ts, event_id) AS rank FROM results GROUP BY ALL),
stat AS (SELECT search_key, CASE WHEN bool_and(ok) THEN 5 WHEN max(s) IS NULL THEN 3
    WHEN min(s) = 5 OR max(s) >= 4 THEN 4 ELSE max(s) END AS status, count(*) FILTER (WHERE NOT ok) AS n
  FROM (SELECT plan.search_key, status AS s, {REUSE_SQL} AS ok
        FROM plan LEFT JOIN info USING (search_key, provider)) GROUP BY 1)
SELECT search_key, {LABEL_SQL} AS status, n AS outstanding, doc_id, rank, source
FROM stat LEFT JOIN (SELECT * FROM idx LEFT JOIN documents USING (doc_id)) c
  ON c.search_key = stat.search_key AND status >= 4
""".replace("SELECT search_key, CASE status", "SELECT stat.search_key, CASE status"))
def search_answers(spark, sf):
    """What each search is answered with now, and how much is left to extract."""
    from gleanery.plans.answers import answer_searches

    index = store.rank_index(
        _ranked_results(spark, sf), ["search_key"], "doc_id", "rank", ["ts", "event_id"]
    ).select("search_key", "doc_id", "rank")
    content = table(spark, sf, "documents").select("doc_id", "source")
    answers = answer_searches(
        _plan(spark, sf), _info(spark, sf), index, content, "search_key", "doc_id", _reuse()
    )
    return answers.select("search_key", "status", "outstanding", "doc_id", "rank", "source")


@R.add("cohort_status", f"""WITH {INFO_SQL} SELECT search_key,
  string_agg(status::VARCHAR, ',' ORDER BY provider) AS statuses FROM info GROUP BY 1""")
def cohort_status(spark, sf):
    found = status.cohort_statuses(_info(spark, sf), ["search_key"], "provider", "status")
    return found.select("search_key", F.array_join("statuses", ",").alias("statuses"))


@R.add("status_transitions", f"""WITH {STATUS_SQL},
steps AS (SELECT *, lag(status) OVER (PARTITION BY search_key, provider ORDER BY ts, event_id) AS previous FROM log)
SELECT event_id, search_key, provider, status, previous, coalesce(
  previous IS NULL AND status = 3 OR previous = status OR previous IN (1, 2) AND status = 3
  OR previous = 3 AND status IN (4, 1, 2) OR previous = 4 AND status = 5 OR previous = 5 AND status = 4,
  false) AS legal FROM steps""")
def status_transitions(spark, sf):
    log = status_log(spark, sf).select("event_id", "search_key", "provider", "status", "ts")
    return status.status_changes(
        log, ["search_key", "provider"], ["ts", "event_id"]
    ).select("event_id", "search_key", "provider", "status", "previous", "legal")


_AGEING = {"patience": 2, "retry": 1, "reopen": 3}


@R.add("status_ageing", f"""WITH RECURSIVE {STATUS_SQL},
seq AS (SELECT search_key, provider, event_id, status, value >= 20 AS answered, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY search_key, provider ORDER BY ts, event_id) AS rn FROM log WHERE status IS NOT NULL),
walk AS (
  SELECT search_key, provider, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS t, NULL::INT AS status, NULL::INT AS previous,
    NULL::BIGINT AS deadline, NULL::INT AS aged, NULL::BOOLEAN AS taken,
    NULL::INT AS held, 0::BIGINT AS since, false AS told FROM seq WHERE rn = 1
  UNION ALL
  SELECT search_key, provider, rn, event_id, t, status, before, deadline, aged, taken,
    CASE WHEN taken THEN status ELSE before END, CASE WHEN taken THEN t ELSE start END,
    CASE WHEN taken THEN answered OR coalesce(before = 3 AND status = 3 AND told, false) ELSE told END
  FROM (SELECT *, coalesce(before IS NULL AND status = 3 OR before = status
      OR before IN (1, 2) AND status = 3 AND t - start >= {_AGEING["retry"]} * 86400000000
      OR before = 3 AND status IN (4, 1, 2) OR before = 4 AND status = 5
      OR before = 5 AND status = 4 AND t - start >= {_AGEING["reopen"]} * 86400000000, false) AS taken
    FROM (SELECT s.*, CASE WHEN w.gone THEN w.given ELSE w.held END AS before,
        CASE WHEN w.gone THEN w.since + {_AGEING["patience"]} * 86400000000 ELSE w.since END AS start,
        CASE WHEN w.gone THEN w.since + {_AGEING["patience"]} * 86400000000 END AS deadline,
        CASE WHEN w.gone THEN w.given END AS aged, w.told AND NOT w.gone AS told
      FROM (SELECT walk.*, seq.t AS next, coalesce(held = 3 AND since + {_AGEING["patience"]} * 86400000000 <= seq.t, false) AS gone,
          CASE WHEN told THEN 2 ELSE 1 END AS given
        FROM walk JOIN seq ON seq.search_key = walk.search_key AND seq.provider = walk.provider AND seq.rn = walk.rn + 1) w
      JOIN seq s ON s.search_key = w.search_key AND s.provider = w.provider AND s.rn = w.rn + 1))),
ends AS (SELECT search_key, provider, last(held ORDER BY rn) AS held, last(since ORDER BY rn) AS since, last(told ORDER BY rn) AS told
  FROM walk GROUP BY 1, 2)
SELECT search_key, provider, event_id, t AS at_micros, status, previous, CASE WHEN taken THEN 'accepted' ELSE 'refused' END AS kind FROM walk WHERE rn > 0
UNION ALL SELECT search_key, provider, NULL, deadline, aged, 3, 'aged' FROM walk WHERE aged IS NOT NULL
UNION ALL SELECT search_key, provider, NULL, since + {_AGEING["patience"]} * 86400000000, CASE WHEN told THEN 2 ELSE 1 END, 3, 'aged'
FROM ends WHERE held = 3""")
def status_ageing(spark, sf):
    """Status writes arrive in three parts, up to four hours out of order; starts without an answer are given up.

    The stream is stopped after each part and goes on from its checkpoint. A last row without a status
    moves the clock beyond every deadline.
    """
    from gleanery.streaming.ageing import Ageing, aged_statuses

    day = 86_400_000_000
    rules = Ageing(**{name: days * day for name, days in _AGEING.items()})
    arriving, progress, out = (scratch_path(spark, n) for n in ("arriving", "progress", "aged"))
    log = status_log(spark, sf).select(
        "search_key", "provider", "event_id", C("ts").cast("timestamp").alias("ts"), "status", (C("value") >= 20).alias("answered")
    )
    arrival = F.unix_micros("ts") + F.pmod("event_id", F.lit(5)) * 3_600_000_000
    ends = log.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).head()
    parts = []
    if ends["lo"] is not None:
        borders = [ends["lo"] + (ends["hi"] - ends["lo"]) * k // 3 for k in (1, 2)]
        part = F.when(arrival < borders[0], 0).when(arrival < borders[1], 1).otherwise(2)
        parts = [log.filter(part == k) for k in range(3)]
        beyond = ends["hi"] + rules.patience + 2 * day
        parts.append(spark.range(1).select(
            F.lit(None).cast("bigint").alias("search_key"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("bigint").alias("event_id"),
            F.timestamp_micros(F.lit(beyond)).alias("ts"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("boolean").alias("answered"),
        ))
    schema = "search_key bigint, provider string, event_id bigint, at_micros bigint, status int, previous int, kind string"
    for rows in parts:
        rows.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(log.schema).parquet(arriving)
        followed = aged_statuses(stream, ["search_key", "provider"], rules, "6 hours")
        named = followed.select("search_key", "provider", "event_id", F.unix_micros("ts").alias("at_micros"), "status", "previous", "kind")
        query = named.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema).parquet(out) if parts else spark.createDataFrame([], schema)


@R.add("stream_upsert", """SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type,
  last(value ORDER BY ts, event_id) FILTER (WHERE value >= 20) AS value,
  last(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY 1""")
def stream_upsert(spark, sf):
    """Events arrive as files, are merged batch by batch, and read back."""
    from gleanery.streaming.upserts import stream_into

    arriving = scratch_path(spark, "arriving")
    events = _event_records(spark, sf).select("user_id", "event_type", "value", "ts", "event_id")
    events.repartition(3, "event_id").write.parquet(arriving)
    kept = store.KeyedStore(
        spark, scratch_path(spark, "store"), ["user_id"], ["ts", "event_id"], events.schema
    )
    stream = stream_into(
        spark, arriving, events.schema, kept, scratch_path(spark, "progress"), files_per_batch=1
    )
    stream.awaitTermination()
    return kept.read().select("user_id", "event_type", "value", "event_id")


@R.add("stream_extraction", f"""WITH {LINKS_SQL},
items AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {HREF_SQL} AS source_url, txt, page_id, idx FROM links)
SELECT source_url, last(txt ORDER BY page_id, idx) AS title, last(page_id ORDER BY page_id, idx) AS page_id
FROM items GROUP BY 1""")
def stream_extraction(spark, sf):
    """Pages arrive as files; each batch is extracted and laid over the stored content."""
    from gleanery.functions.urls import normalize_url, resolve_link
    from gleanery.operators.items import explode_items
    from gleanery.operators.fields import derive_fields
    from gleanery.operators.html import with_nodes
    from gleanery.functions.records import Field, Model
    from gleanery.streaming.upserts import stream_into

    arriving = scratch_path(spark, "arriving")
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    pages.repartition(4, "page_id").write.parquet(arriving)
    model = Model("Link", (Field("source_url"), Field("title")))
    content = {
        "source_url": {"tag_name": "a", "attribute": "href"},
        "title": {"tag_name": "a", "getattr": "text"},
    }

    def extract(batch):
        items = explode_items(with_nodes(batch), {"is_multiple": True, "xpath": "//nav/ul/li"})
        derived = derive_fields(items, model, content)
        link = normalize_url(resolve_link(C("source_url"), C("url")))
        return derived.select(link.alias("source_url"), "title", "page_id", "index")

    schema = "source_url string, title string, page_id bigint, index int"
    kept = store.KeyedStore(
        spark, scratch_path(spark, "content"), ["source_url"], ["page_id", "index"],
        spark.createDataFrame([], schema).schema,
    )
    stream = stream_into(
        spark, arriving, pages.schema, kept, scratch_path(spark, "progress"), extract, 2
    )
    stream.awaitTermination()
    return kept.read().select("source_url", "title", "page_id")


STREAM_SITES = {
    "list": {
        "url": "https://list.example.com/list/{place}/1", "cache_version": "v2",
        "pagination": {"pages": 3, "page_size": 20, "next_page_url": {"tag_name": "a", "attribute": "href"}},
        "items": {"is_multiple": True, "css_selector": "ol.entries > li"},
        "content": {
            "source_url": {"xpath": "./h3/a", "attribute": "href"}, "title": {"tag_name": "h3", "getattr": "text"},
            "publisher": {"tag_name": "b", "getattr": "text"},
        },
    },
    "bare": {"url": "https://list.example.com/list/{place}/1", "items": {"is_multiple": True, "tag_name": "table"},
             "content": {"source_url": "https://a.example/"}},
}
STREAMED_SQL = f"""{LISTED_SQL}, found AS (SELECT c_nationkey::BIGINT AS search_key,
  'https://list.example.com/customer/' || c_custkey AS source_url, c_name, c_mktsegment, pos, page FROM listed WHERE page <= 3)"""


def _streamed(spark, sf):
    """Every listing page arrives twice, for two sites, in several files; the stream stops half way and goes on."""
    from gleanery.functions.records import Field, Model
    from gleanery.plans.extraction import Provider
    from gleanery.streaming.extraction import extraction_stores, stream_extraction

    model = Model("Entry", tuple(Field(n) for n in ("source_url", "title", "publisher")))
    sites = {name: Provider.multi(name, config) for name, config in STREAM_SITES.items()}
    day = _now() + F.make_dt_interval(C("page").cast("int"))
    pages = listing_pages(spark, sf).select(
        C("site").alias("search_key"), F.explode(F.array(*map(F.lit, sites))).alias("provider"), C("page").cast("int").alias("page"),
        "url", "html", day.alias("fetched_at"),
    )
    arriving, progress = scratch_path(spark, "arriving"), scratch_path(spark, "progress")
    stores = extraction_stores(spark, scratch_path(spark, "stores"), model)
    for part in (C("page") % 2 == 1, C("page") % 2 == 0):
        pages.filter(part).repartition(2, "url").write.mode("append").parquet(arriving)
        stream_extraction(spark, arriving, sites, model, stores, progress, 1).awaitTermination()
    stores.fold()
    return stores


@R.add("stream_content", f"""WITH {STREAMED_SQL}
SELECT source_url, c_name AS title, c_mktsegment AS publisher, 'v2' AS version, page FROM found""")
def stream_content(spark, sf):
    """What streamed extraction has stored of each address."""
    content = _streamed(spark, sf).read("content")
    return content.select("source_url", "title", "publisher", C("_cache_version").alias("version"), big("page").alias("page"))


@R.add("stream_ranked", f"""WITH {STREAMED_SQL}
SELECT search_key, unnest([NULL, 'list']) AS provider, source_url, pos AS rank FROM found""")
def stream_ranked(spark, sf):
    """Both ranked indexes of streamed extraction: over all providers, and of each."""
    stores = _streamed(spark, sf)
    overall = stores.read("search_index").withColumn("provider", F.lit(None).cast("string"))
    columns = ["search_key", "provider", "source_url", "rank"]
    return overall.select(*columns).unionByName(stores.read("provider_index").select(*columns))


@R.add("stream_info", f"""WITH {LISTED_SQL}
SELECT c_nationkey::BIGINT AS search_key, provider, CASE provider WHEN 'list' THEN 5 ELSE 2 END AS status,
  CASE provider WHEN 'list' THEN 'v2' END AS cache_version,
  CAST(TIMESTAMP '{NOW}' + to_days(CASE provider WHEN 'list' THEN least(max(page), 3) ELSE 1 END::INT) AS DATE)::VARCHAR AS last_day
FROM listed, (SELECT unnest(['list', 'bare']) AS provider) GROUP BY 1, 2""")
def stream_info(spark, sf):
    """Extraction info of streamed extraction."""
    info = _streamed(spark, sf).read("info")
    return info.select("search_key", "provider", "status", "cache_version", C("last_extracted").cast("date").cast("string").alias("last_day"))


# --- groups, order, routing ----------------------------------------------------


@R.add("constrain_groups", """SELECT l_orderkey, count(*) AS received, CASE WHEN count(*) < 3 THEN 'too few'
  WHEN count(*) > 5 THEN 'too many' ELSE 'ok' END AS outcome FROM lineitem GROUP BY 1""")
def constrain_groups(spark, sf):
    return cardinality.constrain(table(spark, sf, "lineitem"), ["l_orderkey"], minimum=3, maximum=5)


@R.add("one_per_group", """SELECT l_orderkey, count(*) AS received,
  CASE WHEN count(*) > 1 THEN 'too many' ELSE 'ok' END AS outcome,
  CASE WHEN count(*) = 1 THEN min(l_partkey) END AS l_partkey FROM lineitem GROUP BY 1""")
def one_per_group(spark, sf):
    return cardinality.one(table(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey")


@R.add("count_phrases", """SELECT o_custkey, CASE n WHEN 1 THEN '1 leaf' ELSE n || ' leaves' END AS plain,
  CASE n WHEN 8 THEN 'all of an orange in 8' WHEN 11 THEN 'an 11-part order' WHEN 12 THEN 'a 12-part order'
    WHEN 1 THEN 'an orange' ELSE 'a few oranges' END AS special
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def count_phrases(spark, sf):
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    special = phrases.count_phrase(
        C("n"), "orange/s",
        "8=all of $a $thing in $n;11=$a $n-part order;12=$a $n-part order",
        "1=$a $thing;n=a few $things",
    )
    return counted.select(
        "o_custkey", phrases.count_phrase(C("n"), "lea/f/ves").alias("plain"),
        special.alias("special"),
    )


def _words(spark, sf):
    """Pronunciation table derived from the documents' words, by a made-up rule."""
    words = work_table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")
    ).distinct()
    first = F.substring("word", 1, 1)
    odd = F.substring("word", 2, 1).isin("u", "o")
    vowel = first.isin("a", "e", "i", "o", "u")
    phoneme = F.when(vowel != odd, F.concat(F.upper(first), F.lit("H1"))).otherwise(F.upper(first))
    return words.select("word", F.array(F.array(phoneme, F.lit("X"))).alias("pronunciations"))


WORDS_SQL = """words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS word
  FROM documents),
odd AS (SELECT word, CASE WHEN left(word, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'consonant_sounding_vowel_led'
  ELSE 'vowel_sounding_consonant_led' END AS kind FROM words WHERE substr(word, 2, 1) IN ('u', 'o'))"""


@R.add("exception_words", f"WITH {WORDS_SQL} SELECT word, kind FROM odd")
def exception_words(spark, sf):
    """The exceptions, kept as a stored dictionary in between."""
    path = scratch_path(spark, "exceptions")
    tables.write_dictionary(phrases.exception_words(_words(spark, sf)).select("word", "kind"), path)
    return tables.read_dictionary(spark, path, "word string, kind string")


@R.add("article_labels", """WITH odd AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part
  WHERE left(p_name, 1) IN ('o', 'h'))
SELECT p_partkey, CASE WHEN CASE WHEN left(w, 1) IN ('a','e','i','o','u') THEN w NOT IN (FROM odd)
    ELSE w IN (FROM odd) END THEN 'an ' ELSE 'a ' END || p_name AS named,
  CASE WHEN left(p_size::VARCHAR, 1) = '8' OR p_size::VARCHAR IN ('11', '18') THEN 'an ' ELSE 'a ' END || p_size || '-inch ' || p_name AS sized,
  CASE WHEN thousands[1] = '8' OR thousands[1:2] IN ('11', '18') THEN 'an ' ELSE 'a ' END || thousands || ' piece' AS counted
FROM (SELECT *, split_part(p_name, ' ', 1) AS w, p_size || ',000' AS thousands FROM part)""")
def article_labels(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    odd = parts.select(F.substring_index("p_name", " ", 1).alias("word")).filter(
        F.substring("word", 1, 1).isin("o", "h")
    )
    named = phrases.with_articles(parts, "p_name", odd, "named")
    sized = F.concat(C("p_size").cast("string"), F.lit("-inch "), "p_name")
    counted = F.concat(C("p_size").cast("string"), F.lit(",000 piece"))
    labelled = lambda text: F.concat(phrases.article(text), F.lit(" "), text)
    return named.select(
        "p_partkey", "named", labelled(sized).alias("sized"), labelled(counted).alias("counted")
    )


@R.add("dedup_keep_last", f"""SELECT {HOST_SQL} AS domain, max(page_id) AS page_id, arg_max(url, page_id) AS url,
  min(page_id) AS position FROM pages GROUP BY 1""")
def dedup_keep_last(spark, sf):
    return assemble.keep_last(page_hosts(spark, sf), "domain", ["page_id"])


@R.add("collisions", f"""SELECT * FROM (SELECT page_id, {HOST_SQL} AS domain, url AS new_url,
  lag(url) OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS old_url FROM pages) WHERE old_url IS NOT NULL""")
def collisions(spark, sf):
    pages = page_hosts(spark, sf)
    pairs = assemble.collisions(
        pages, "domain", ["page_id"], ["page_id", "url"]
    )
    return pairs.select("page_id", "domain", C("url").alias("new_url"), C("old.url").alias("old_url"))


@R.add("urls_by_domain", f"""SELECT {HOST_SQL} AS domain, url,
  row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS position,
  count(*) OVER (PARTITION BY {HOST_SQL}) AS size FROM pages""")
def urls_by_domain(spark, sf):
    return crawl.urls_by_domain(page_hosts(spark, sf), "domain", "page_id", size="size").select(
        "domain", "url", big("position").alias("position"), "size"
    )


@R.add("fetch_schedule", f"""SELECT page_id, domain, CAST(coalesce(sum(CASE WHEN p = 1 THEN 0 ELSE gap END)
    OVER (PARTITION BY domain ORDER BY page_id ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS start
FROM (SELECT page_id, {HOST_SQL} AS domain, page_id % 5 + 1 AS gap,
        row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS p FROM pages)""")
def fetch_schedule(spark, sf):
    queued = crawl.urls_by_domain(page_hosts(spark, sf), "domain", "page_id")
    gap = (C("page_id") % 5 + 1).cast("double")
    return crawl.schedule(queued, "domain", "position", gap).select("page_id", "domain", "start")


def _directories(spark, sf):
    """Configured directories: hosts but spam, and their English and German parts."""
    pages = page_hosts(spark, sf)
    host = F.replace(F.regexp_replace("domain", r"^www\.", ""), F.lit("."), F.lit("_"))
    part = F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)
    rows = pages.select(host.alias("host"), part.alias("part")).distinct()
    spam = C("host").startswith("spam")
    hosts = rows.select(C("host").alias("directory")).distinct().select(
        "directory", (~C("directory").startswith("blog")).alias("has_source"),
        (~C("directory").startswith("m_")).alias("is_enabled"),
    ).filter(~C("directory").startswith("spam"))
    parts = rows.filter(C("part").isin("en", "de") & ~spam).select(
        F.concat("host", F.lit("/"), "part").alias("directory"), F.lit(True).alias("has_source"),
        (C("part") == "en").alias("is_enabled"),
    )
    orphans = rows.filter(spam).select(
        F.concat("host", F.lit("/"), "part").alias("directory"), F.lit(True).alias("has_source"),
        F.lit(True).alias("is_enabled"),
    )
    return assemble.union_all([hosts, parts, orphans])


ROUTE_SQL = f"""routed AS (SELECT page_id, url, CASE WHEN starts_with(host, 'spam') THEN NULL
    WHEN part IN ('en', 'de') THEN host || '/' || part WHEN NOT starts_with(host, 'blog') THEN host END AS directory,
    CASE WHEN part IN ('en', 'de') THEN part = 'en' ELSE NOT starts_with(host, 'm_') END AS is_enabled
  FROM (SELECT page_id, url, replace(regexp_replace({HOST_SQL}, '^www\\.', ''), '.', '_') AS host,
          regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS part FROM pages))"""


@R.add("route_longest_prefix", f"WITH {ROUTE_SQL} SELECT page_id, directory FROM routed WHERE directory IS NOT NULL")
def route_longest_prefix(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return assemble.route(pages, _directories(spark, sf), key="page_id").select("page_id", "directory")


@R.add("routable_urls", f"WITH {ROUTE_SQL} SELECT page_id, url FROM routed WHERE directory IS NOT NULL AND is_enabled")
def routable_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return assemble.routable(pages, _directories(spark, sf), key="page_id")


# --- random draws: seeded, from digits of a hash --------------------------------


def _uniform_sql(*key):
    digits = f"substr(md5(concat_ws('|', '42', {', '.join(key)})), 1, 13)"
    return f"((CAST('0x' || {digits} AS BIGINT) + 0.5) / 4503599627370496.0)"


def _index_sql(rate, length, *key):
    tries = [f"-ln({_uniform_sql(str(i), *key)}) / {rate}" for i in range(crawl.ATTEMPTS)]
    hits = ", ".join(f"CASE WHEN {d} < {length} THEN CAST(floor({d}) AS BIGINT) END" for d in tries)
    return f"coalesce({hits}, 0)"


def _dwell_sql(settings, key):
    low = (settings.minimum - settings.base) / settings.multiplier
    high = (settings.maximum - settings.base) / settings.multiplier
    hits = []
    for i in range(crawl.ATTEMPTS):
        radius, angle = (_uniform_sql(f"'{part}'", str(i), key) for part in ("radius", "angle"))
        d = f"exp({settings.mu} + {settings.sigma} * (sqrt(-2 * ln({radius})) * cos(2 * pi() * {angle})))"
        hits.append(f"CASE WHEN {d} BETWEEN {low} AND {high} THEN {d} END")
    mode = f"exp({settings.mu} - {settings.sigma} * {settings.sigma})"
    return f"round({settings.base} + coalesce({', '.join(hits)}, {mode}) * {settings.multiplier}, 6)"


SITE_DWELL = crawl.Dwell.from_config({"base": 0, "multiplier": 2, "maximum": 4, "unread": 1})


@R.add("random_per_group", f"""SELECT s_nationkey, arg_max(s_suppkey, ({_uniform_sql('s_suppkey')}, s_suppkey)) AS s_suppkey,
  arg_max(s_name, ({_uniform_sql('s_suppkey')}, s_suppkey)) AS s_name,
  arg_max(s_acctbal, ({_uniform_sql('s_suppkey')}, s_suppkey)) AS s_acctbal FROM supplier GROUP BY 1""")
def random_per_group(spark, sf):
    return crawl.random_per_group(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", 42)


def _order_sql(rate):
    return f"""WITH RECURSIVE lists AS (SELECT {HOST_SQL} AS domain, list(page_id ORDER BY page_id) AS pages FROM pages GROUP BY 1),
walk AS (
  SELECT domain, CAST(0 AS BIGINT) AS pick, len(pages) AS n, range(1, len(pages) + 1) AS rest, CAST(NULL AS BIGINT) AS position FROM lists
  UNION ALL
  SELECT domain, pick + 1, n, rest[:j] || rest[j + 2:], rest[j + 1]
  FROM (SELECT *, {_index_sql(rate, '(n - pick)', 'domain', 'pick')} AS j FROM walk WHERE pick < n))
SELECT domain, pages[position] AS page_id, position, pick FROM walk JOIN lists USING (domain) WHERE pick > 0"""


def _picked(spark, sf, rate):
    queued = crawl.urls_by_domain(page_hosts(spark, sf), "domain", "page_id", size="size")
    return crawl.popularity_order(
        queued.select("domain", "page_id", "position", "size"), "domain", "position", "size", 42, rate
    ).select("domain", "page_id", big("position").alias("position"), big("pick").alias("pick"))


@R.add("weighted_order", _order_sql(crawl.SELECTION_RATE))
def weighted_order(spark, sf):
    return _picked(spark, sf, crawl.SELECTION_RATE)


@R.add("weighted_order_patient", _order_sql(0.05))
def weighted_order_patient(spark, sf):
    """A reader who looks far down a list: hardly any pick uses up those passed over."""
    return _picked(spark, sf, 0.05)


@R.add("exp_index", f"""SELECT o_orderkey, {_index_sql(crawl.SELECTION_RATE, 20, 'o_orderkey')} AS picked FROM orders""")
def exp_index(spark, sf):
    index = crawl.exponential_index(crawl.SELECTION_RATE, F.lit(20), 42, C("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", index.alias("picked"))


@R.add("dwell_times", f"""SELECT page_id, {_dwell_sql(crawl.Dwell(), 'page_id')} AS default_dwell,
  {_dwell_sql(SITE_DWELL, 'page_id')} AS site_dwell FROM pages""")
def dwell_times(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.round(crawl.Dwell().column(42, C("page_id")), 6).alias("default_dwell"),
        F.round(SITE_DWELL.column(42, C("page_id")), 6).alias("site_dwell"),
    )

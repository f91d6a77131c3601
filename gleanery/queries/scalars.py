"""Scalar functions: templates, URLs, dates, records, keys, enumerations."""

from pyspark.sql import functions as F

from gleanery.functions import dates, keys, records, templates, urls
from gleanery.functions.enums import Enumeration
from gleanery.operators.cardinality import changed_rows
from gleanery.operators.fields import excise as excise_snippets
from gleanery.operators.fields import join_values as join_texts
from gleanery.operators.fields import split_values as split_texts
from gleanery.queries.common import HOST_SQL, LINKS_SQL, Registry, big, parsed_pages, table, work_table

R = Registry()
C = F.col


@R.add("public_fields", "SELECT doc_id, lang, source, n_chars FROM documents")
def public_fields(spark, sf):
    stored = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.lit("v1").alias("_cache_version"), F.col("n_chars").alias("_size"),
    )
    return records.public_columns(stored)


@R.add("rows_changed", """WITH new AS (
  SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS c_nationkey,
    c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey, CASE WHEN new.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM customer o LEFT JOIN new USING (c_custkey)
WHERE new.c_custkey IS NULL OR o.c_nationkey IS DISTINCT FROM new.c_nationkey
   OR o.c_acctbal IS DISTINCT FROM new.c_acctbal""")
def rows_changed(spark, sf):
    old = table(spark, sf, "customer")
    new = old.filter("c_acctbal >= 0").withColumns(
        {
            "c_nationkey": F.when(C("c_nationkey") != 7, C("c_nationkey")),
            "c_acctbal": C("c_acctbal") + F.when(C("c_mktsegment") == "BUILDING", 1).otherwise(0),
        }
    )
    return changed_rows(old, new, "c_custkey").select("c_custkey", "change")


@R.add("parse_template", r"""SELECT o_orderkey,
  nullif(regexp_extract(o_orderpriority, '(?is)^.+?-(.+?)$', 1), '') AS level,
  nullif(regexp_extract(o_orderpriority, '(?is)^(.+?)-high$', 1), '') AS high,
  CASE WHEN regexp_matches(o_orderpriority, '(?is)^.+?-.+?$') THEN NULL ELSE '' END AS uncaptured
FROM orders""")
def parse_template(spark, sf):
    text = C("o_orderpriority")
    parse = lambda *t: templates.parse_templates(text, list(t))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        parse("{}-{value}").alias("level"),
        parse("{value}-HIGH").alias("high"),
        F.coalesce(parse("{}-{}", "{value}"), F.when(text.isNull(), F.lit(""))).alias("uncaptured"),
    )


@R.add("multi_parse", r"""SELECT page_id, coalesce(
  nullif(regexp_extract(url, '(?is)^https://(.+?)/en/.+?$', 1), ''),
  nullif(regexp_extract(url, '(?is)^http://.+?\?page=(.+?)&.+?$', 1), ''),
  nullif(regexp_extract(url, '(?is)^.+?://www\.(.+?)/.+?$', 1), '')) AS value FROM pages""")
def multi_parse(spark, sf):
    found = templates.parse_templates(
        C("url"), ["https://{value}/en/{}", "http://{}?page={value}&{}", "{}://www.{value}/{}"]
    )
    return table(spark, sf, "pages").select("page_id", found.alias("value"))


@R.add("derive_domain", f"""SELECT page_id, {HOST_SQL} AS domain, {HOST_SQL} AS no_scheme,
  {HOST_SQL} AS bare, {HOST_SQL} AS from_base, NULL::VARCHAR AS baseless FROM pages""")
def derive_domain(spark, sf):
    url = C("url")
    rest = F.regexp_replace(url, "^[a-z]+:", "")
    path = F.regexp_replace(url, "^[a-z]+://[^/?#]*", "")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.derive_domain(url).alias("domain"),
        urls.derive_domain(rest).alias("no_scheme"),
        urls.derive_domain(F.regexp_replace(url, "^[a-z]+://", "")).alias("bare"),
        urls.derive_domain(path, url).alias("from_base"),
        urls.derive_domain(path, path).alias("baseless"),
    )


@R.add("clip_url", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  url, '^https?://', ''), '^www\.', ''), '\?.*$', ''), '/$', '') AS clipped FROM pages""")
def clip_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clip_url(C("url")).alias("clipped"))


@R.add("normalize_url", """SELECT page_id, url AS plain, url AS messy, 'https://' || domain || '/' AS bare
FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages)""")
def normalize_url(spark, sf):
    """Addresses made untidy in ways the normal form undoes."""
    url = C("url")
    scheme = F.regexp_extract(url, "^([a-z]+)", 1)
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    rest = F.regexp_replace(url, "^[a-z]+://[^/?#]*", "")
    port = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
    messy = F.concat(F.upper(scheme), F.lit("://"), F.upper(host), port, F.lit("/x/./.."), rest)
    return table(spark, sf, "pages").select(
        "page_id",
        urls.normalize_url(url).alias("plain"),
        urls.normalize_url(messy).alias("messy"),
        urls.normalize_url(host).alias("bare"),
    )


#: A host beyond ASCII and a path, as found and in normal form.
FOREIGN = [
    ("b\u00fccher", "xn--bcher-kva", "%7euser/%41", "~user/A"),
    ("M\u00dcNCHEN", "xn--mnchen-3ya", "\u00e9", "%C3%A9"),
    ("\u043f\u0440\u0438\u043c\u0435\u0440", "xn--e1afmkfd", "a%2fb", "a%2Fb"),
    ("fa\u00df", "xn--fa-hia", "100%", "100%25"),
    ("plain", "plain", "a b", "a%20b"),
]
_FORMS = " ".join(f"WHEN {i} THEN '{host}.' || host || '/{path}/' || page_id" for i, (_, host, _, path) in enumerate(FOREIGN))


@R.add("normalize_foreign", f"""SELECT page_id, 'https://' || CASE page_id % {len(FOREIGN)} {_FORMS} END AS normal
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def normalize_foreign(spark, sf):
    """Addresses with hosts beyond ASCII and escapes in several spellings."""
    host, number = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.pmod("page_id", F.lit(len(FOREIGN)))
    found = [F.concat(F.lit(f"HTTPS://{a}."), host, F.lit(f":443/{b}/"), C("page_id").cast("string")) for a, _, b, _ in FOREIGN]
    spelled = F.get(F.array(*found), number.cast("int"))
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(spelled).alias("normal"))


@R.add("url_quote", """SELECT p_partkey, replace(url_encode(
  p_name || '/' || p_brand || ' *~(' || p_type || ')&=+é'), '%2F', '/') AS quoted FROM part""")
def url_quote(spark, sf):
    text = F.concat(
        C("p_name"), F.lit("/"), C("p_brand"), F.lit(" *~("), C("p_type"), F.lit(")&=+é")
    )
    return table(spark, sf, "part").select("p_partkey", urls.url_quote(text).alias("quoted"))


# --- dates -------------------------------------------------------------------


@R.add("strptime_granular", """SELECT o_orderkey,
  strftime(coalesce(try_strptime(text, '%d %B %Y'), try_strptime(text, '%B %Y'), try_strptime(text, '%Y')),
           '%Y-%m-%d') AS day,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 END AS granularity,
  NULL::VARCHAR AS unreal
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d %B %Y')
        WHEN 'O' THEN strftime(o_orderdate, '%B %Y') WHEN 'P' THEN strftime(o_orderdate, '%Y') END AS text
      FROM orders)""")
def strptime_granular(spark, sf):
    status, day = C("o_orderstatus"), C("o_orderdate")
    text = (
        F.when(status == "F", F.date_format(day, "d MMMM yyyy"))
        .when(status == "O", F.upper(F.date_format(day, "MMMM yyyy")))
        .when(status == "P", F.date_format(day, "yyyy"))
    )
    orders = work_table(spark, sf, "orders").withColumn("text", text)
    parsed = orders.withColumn("g", dates.strptime(C("text"), ["%d %B %Y", "%B %Y", "%Y"]))
    unreal = dates.strptime(F.concat(F.lit("31 February "), F.date_format(day, "yyyy")), ["%d %B %Y"])
    return parsed.select(
        "o_orderkey",
        F.date_format(C("g.ts"), "yyyy-MM-dd").alias("day"),
        C("g.granularity").cast("int").alias("granularity"),
        dates.serialize_granular(unreal).alias("unreal"),
    )


def _precision():
    return (C("o_orderkey") % 7 + 1).cast("int")


def _moment():
    micros = F.unix_micros(C("o_orderdate").cast("timestamp"))
    return F.timestamp_micros(
        micros + C("o_orderkey") * 1234567891 % 86400000000
    ).cast("timestamp_ntz")


MOMENT_SQL = (
    "(o_orderdate + to_microseconds(o_orderkey * 1234567891 % 86400000000))"
)
SERIAL_SQL = f"""CASE o_orderkey % 7 + 1 WHEN 1 THEN strftime({MOMENT_SQL}, '%Y')
  WHEN 2 THEN strftime({MOMENT_SQL}, '%Y-%m') WHEN 3 THEN strftime({MOMENT_SQL}, '%Y-%m-%d')
  WHEN 4 THEN strftime({MOMENT_SQL}, '%Y-%m-%dT%H') WHEN 5 THEN strftime({MOMENT_SQL}, '%Y-%m-%dT%H:%M')
  WHEN 6 THEN strftime({MOMENT_SQL}, '%Y-%m-%dT%H:%M:%S')
  WHEN 7 THEN strftime({MOMENT_SQL}, '%Y-%m-%dT%H:%M:%S.%f') END"""


@R.add("granular_serialize", f"SELECT o_orderkey, {SERIAL_SQL} AS serial FROM orders")
def granular_serialize(spark, sf):
    value = dates.granular(_moment(), _precision())
    return work_table(spark, sf, "orders").withColumn("g", value).select(
        "o_orderkey", dates.serialize_granular(C("g")).alias("serial")
    )


@R.add("granular_deserialize", """SELECT o_orderkey,
  strftime(o_orderdate, '%Y-%m-%d') AS padded, 3 AS padded_granularity,
  strftime(o_orderdate, '%Y-%m-%d') AS unpadded,
  strftime(o_orderdate, '%Y') || '-01-01' AS year_only, 1 AS year_granularity,
  NULL::INTEGER AS bad_day, NULL::INTEGER AS bad_second, NULL::INTEGER AS open_end FROM orders""")
def granular_deserialize(spark, sf):
    day = C("o_orderdate")
    texts = {
        "padded": F.date_format(day, "yyyy-MM-dd"),
        "unpadded": F.date_format(day, "yyyy-M-d"),
        "year": F.date_format(day, "yyyy"),
        "bad_day": F.date_format(day, "yyyy-'02-30'"),
        "bad_second": F.date_format(day, "yyyy-MM-dd'T12:34:60'"),
        "open_end": F.date_format(day, "yyyy-MM-"),
    }
    parsed = work_table(spark, sf, "orders").select(
        "o_orderkey", *[dates.deserialize_granular(t).alias(n) for n, t in texts.items()]
    )
    text = lambda n: F.date_format(C(f"{n}.ts"), "yyyy-MM-dd")
    code = lambda n: C(f"{n}.granularity").cast("int")
    return parsed.select(
        "o_orderkey", text("padded").alias("padded"), code("padded").alias("padded_granularity"),
        text("unpadded").alias("unpadded"), text("year").alias("year_only"),
        code("year").alias("year_granularity"), code("bad_day").alias("bad_day"),
        code("bad_second").alias("bad_second"), code("open_end").alias("open_end"),
    )


@R.add("granular_convert", f"""SELECT o_orderkey, strftime({MOMENT_SQL}, '%Y-%m-%dT%H:%M:%S.%f') AS full_text,
  7 AS default_granularity, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 7 END AS given FROM orders""")
def granular_convert(spark, sf):
    orders = work_table(spark, sf, "orders").select(
        "o_orderkey",
        dates.from_datetime(_moment()).alias("plain"),
        dates.from_datetime(_moment(), F.when(C("o_orderstatus") == "F", F.lit(3))).alias("given"),
    )
    return orders.select(
        "o_orderkey",
        F.date_format(dates.to_datetime(C("plain")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("full_text"),
        C("plain.granularity").cast("int").alias("default_granularity"),
        C("given.granularity").cast("int").alias("given"),
    )


@R.add("epoch_auto", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_seconds,
  strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS from_millis,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS from_micros,
  strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS in_tokyo FROM events""")
def epoch_auto(spark, sf):
    micros = F.unix_micros(C("ts").cast("timestamp"))
    seconds, millis = F.floor(micros / 1000000), F.floor(micros / 1000)
    text = lambda c, f: F.date_format(c, f)
    whole, fine = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return work_table(spark, sf, "events").select(
        "event_id",
        text(dates.epoch_to_utc(seconds), whole).alias("from_seconds"),
        text(dates.epoch_to_utc(millis), fine).alias("from_millis"),
        text(dates.epoch_to_utc(micros, 1e-6), fine).alias("from_micros"),
        text(dates.epoch_to_local(seconds, "Asia/Tokyo"), whole).alias("in_tokyo"),
    )


@R.add("strftime", """SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS long_form,
  strftime(o_orderdate, 'Published: %b %Y') AS labelled, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS full_form
FROM orders""")
def strftime(spark, sf):
    day = C("o_orderdate")
    return work_table(spark, sf, "orders").select(
        "o_orderkey",
        dates.strftime(day, "%d %B %Y").alias("long_form"),
        dates.strftime(day, "Published: %b %Y").alias("labelled"),
        dates.strftime(day, "%Y/%m/%d %H:%M:%S").alias("full_form"),
    )


# --- texts -------------------------------------------------------------------


@R.add("format_template", """SELECT c_custkey, 'https://x.org/' || lower(c_mktsegment) || '/' || c_custkey
  || '?by=' || c_name AS link, CASE WHEN c_acctbal >= 0 THEN c_name || '!' END AS nullable FROM customer""")
def format_template(spark, sf):
    value = F.concat(F.lower("c_mktsegment"), F.lit("/"), C("c_custkey"))
    positive = F.when(C("c_acctbal") >= 0, C("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        templates.format_template("https://x.org/{value}?by={c_name}", value, C).alias("link"),
        templates.format_template("{value}!", positive, C).alias("nullable"),
    )


@R.add("excise", """SELECT doc_id, replace(replace(text, 'the ', ''), E'\\n', '') AS cleansed FROM documents""")
def excise(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", excise_snippets(C("text"), ["the ", "\n"]).alias("cleansed")
    )


@R.add("join_values", f"""WITH {LINKS_SQL}
SELECT page_id, string_agg(txt, '; ' ORDER BY idx) AS joined, '' AS none, NULL::VARCHAR AS with_null
FROM links GROUP BY 1""")
def join_values(spark, sf):
    from gleanery.operators.html import element_text
    from gleanery.operators.select import find_all

    texts = F.transform(find_all(C("nodes"), "css_selector", "li a"), element_text)
    found = parsed_pages(spark, sf).select("page_id", texts.alias("t"))
    return found.select(
        "page_id",
        join_texts(C("t"), "; ").alias("joined"),
        join_texts(F.slice("t", 1, 0), "; ").alias("none"),
        join_texts(F.array_append("t", F.lit(None).cast("string")), "; ").alias("with_null"),
    )


@R.add("split_values", """SELECT doc_id, pos::BIGINT AS pos, part FROM (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM (
    SELECT doc_id, string_split(lang || '.|' || source, '.|') || string_split(text, '. ') AS parts
    FROM (SELECT doc_id, lang, source, replace(text, '.|', '. ') AS text FROM documents)))""")
def split_values(spark, sf):
    docs = table(spark, sf, "documents")
    head = split_texts(F.array(F.concat("lang", F.lit(".|"), "source")), F.lit(".|"))
    body = split_texts(F.array(F.replace("text", F.lit(".|"), F.lit(". "))), F.lit(". "))
    return docs.select("doc_id", F.posexplode(F.concat(head, body)).alias("pos", "part")).select(
        "doc_id", big("pos").alias("pos"), "part"
    )


@R.add("get_reference", """SELECT o_orderkey, o_orderpriority AS plain, o_orderstatus AS dotted,
  strftime(o_orderdate, '%Y-%m-%d') AS as_date, 3 AS precision, 'DAY' AS precision_name,
  NULL::VARCHAR AS short_circuit FROM orders""")
def get_reference(spark, sf):
    from gleanery.operators.fields import Context

    orders = work_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.struct(F.struct(C("o_orderstatus").alias("code")).alias("status")).alias("state"),
        dates.granular(C("o_orderdate"), F.lit(3)).alias("day"),
        F.lit(None).cast("struct<code:string>").alias("absent"),
    )
    kinds = {"o_orderpriority": "text", "state": "text", "absent": "text", "day": "date"}
    get = Context(None, None, kinds).resolve
    return orders.select(
        "o_orderkey",
        get("o_orderpriority").alias("plain"),
        get("state.status.code").alias("dotted"),
        get("day").alias("as_date"),
        get("day.granularity").cast("int").alias("precision"),
        get("day.granularity.name").alias("precision_name"),
        get("absent.code").alias("short_circuit"),
    )


@R.add("render_references", r"""SELECT c_custkey, 'dear ' || c_name || ' by ' || c_mktsegment || '.' AS rendered,
  '<' || '>' AS blank, regexp_replace(c_name, '^.*#', '') AS parsed FROM customer""")
def render_references(spark, sf):
    customers = table(spark, sf, "customer").withColumns(
        {"missing": F.lit(None).cast("string"), "prefix": F.regexp_extract("c_name", "^(.*#)", 1)}
    )
    render = templates.render_references
    # The parse template itself depends on the row.
    parsed = templates.parse_templates(C("c_name"), ["<prefix>{value}"], C)
    return customers.select(
        "c_custkey",
        render("dear <c_name> by <c_mktsegment>.", C).alias("rendered"),
        F.concat(F.lit("<"), render("<missing>", C), F.lit(">")).alias("blank"),
        parsed.alias("parsed"),
    )


# --- records -----------------------------------------------------------------

CUSTOMER = records.Model(
    "Customer",
    (
        records.Field("c_custkey", "bigint"),
        records.Field("c_name"),
        records.Field("c_nationkey", "int"),
        records.Field("segment"),
        records.Field("since", "timestamp", "since_granularity"),
        records.Field("since_granularity", "granularity"),
    ),
    {"segment": lambda text, hashed: F.lower(text)},
)


def _customer_records(spark, sf):
    day = F.timestamp_micros(C("c_custkey") * 86400000001).cast("timestamp_ntz")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(C("c_mktsegment") != "BUILDING", C("c_mktsegment")).alias("segment"),
        day.alias("since"),
        (C("c_custkey") % 7 + 1).cast("tinyint").alias("since_granularity"),
    )


LABELS_SQL = (
    "['YEAR', 'MONTH', 'DAY', 'HOUR', 'MINUTE', 'SECOND', 'MICROSECOND'][c_custkey % 7 + 1]"
)
SINCE_SQL = "make_timestamp(c_custkey * 86400000001)"


@R.add("to_hash", f"""SELECT c_custkey, unnest(['__model__', 'c_custkey', 'c_name', 'c_nationkey', 'since',
    'since_granularity']) AS k,
  unnest(['Customer', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR,
    strftime({SINCE_SQL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({SINCE_SQL}) % 1000000 = 0 THEN ''
      ELSE strftime({SINCE_SQL}, '.%f') END,
    'Granularity.' || {LABELS_SQL}]) AS v
FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def to_hash(spark, sf):
    hashed = _customer_records(spark, sf).withColumn("h", records.to_hash(CUSTOMER))
    return hashed.select("c_custkey", F.explode("h").alias("k", "v"))


@R.add("from_hash", f"""SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS segment,
  strftime({SINCE_SQL}, '%Y-%m-%dT%H:%M:%S.%f') AS since, (c_custkey % 7 + 1)::INT AS granularity
FROM customer""")
def from_hash(spark, sf):
    stored = _customer_records(spark, sf).select(
        F.map_concat(
            F.map_filter(records.to_hash(CUSTOMER), lambda k, v: k != "segment"),
            F.create_map(F.lit("segment"), F.coalesce("segment", F.lit("null"))),
        ).alias("h")
    )
    back = stored.select(*records.from_hash(C("h"), CUSTOMER))
    return back.select(
        "c_custkey", "c_name", "c_nationkey", "segment",
        F.date_format("since", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("since"),
        C("since_granularity").cast("int").alias("granularity"),
    )


@R.add("to_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","rank":' ||
  CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR ELSE 'null' END || ',"title":null}' AS json FROM nation""")
def to_json(spark, sf):
    columns = [
        C("n_name"),
        F.when(C("n_regionkey") > 0, C("n_regionkey")).alias("rank"),
        F.lit(None).cast("string").alias("title"),
    ]
    return table(spark, sf, "nation").select("n_nationkey", records.to_json(columns).alias("json"))


@R.add("serialize_values", f"""SELECT o_orderkey,
  strftime({MOMENT_SQL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({MOMENT_SQL}) % 1000000 = 0 THEN ''
    ELSE strftime({MOMENT_SQL}, '.%f') END AS at,
  strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
  o_orderkey::VARCHAR AS number, CASE WHEN o_orderstatus = 'F' THEN 'Granularity.DAY' ELSE 'null' END AS precision
FROM orders""")
def serialize_values(spark, sf):
    precision = F.when(C("o_orderstatus") == "F", F.lit(3))
    return work_table(spark, sf, "orders").select(
        "o_orderkey",
        records.serialize_value(_moment(), "timestamp").alias("at"),
        records.serialize_value(C("o_orderdate"), "date").alias("day"),
        records.serialize_value(C("o_totalprice").cast("decimal(12,2)"), "decimal").alias("price"),
        records.serialize_value(C("o_orderkey"), "bigint").alias("number"),
        records.serialize_value(precision, "granularity").alias("precision"),
    )


@R.add("encode_decode", """SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS digest,
  hex(encode(CASE WHEN lang = 'en' THEN source ELSE 'null' END)) AS nullable,
  CASE WHEN lang = 'en' THEN source END AS decoded FROM documents""")
def encode_decode(spark, sf):
    english = F.when(C("lang") == "en", C("source"))
    utf8 = records.safe_encode(C("text"), "utf-8")
    utf16 = records.safe_encode(english, "utf-16")
    return table(spark, sf, "documents").select(
        "doc_id",
        big(F.octet_length(utf8)).alias("n_bytes"),
        F.md5(records.safe_decode(utf8, "utf-8").cast("binary")).alias("digest"),
        F.hex(records.safe_encode(english, "utf-8")).alias("nullable"),
        records.safe_decode(utf16, "utf-16").alias("decoded"),
    )


# --- keys --------------------------------------------------------------------


def _nation_key(display):
    name, key = C("n_name"), C("n_nationkey")
    fields = F.array(
        keys.key_field("name", F.array(name, F.lower(name)), many=True),
        keys.key_field("region", F.when(C("n_regionkey") > 0, C("n_regionkey"))),
    )
    return keys.build_key(F.array(F.lit("nation"), key.cast("string")), fields, display)


KEY_SQL = """'nation' || {t} || n_nationkey || {t} || 'name' || {a} || n_name || {s} || lower(n_name) || {t} ||
  'region' || {a} || CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR ELSE {n} END"""
DISPLAY_SQL = KEY_SQL.format(t="'&'", a="'='", s="'|'", n="'~'")


@R.add("key_build", f"""SELECT n_nationkey, {DISPLAY_SQL} AS display,
  {KEY_SQL.format(t="chr(1)", a="chr(2)", s="chr(3)", n="'<nul>'")} AS machine FROM nation""")
def key_build(spark, sf):
    machine = F.replace(_nation_key(False), F.lit(chr(0)), F.lit("<nul>"))
    return table(spark, sf, "nation").select(
        "n_nationkey", _nation_key(True).alias("display"), machine.alias("machine")
    )


@R.add("key_parse", """SELECT n_nationkey, form, 'nation,' || n_nationkey AS qualifiers,
  unnest(['name', 'region']) AS field,
  unnest([n_name || ',' || lower(n_name), CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END]) AS parts
FROM nation, (VALUES ('machine'), ('display')) f(form)""")
def key_parse(spark, sf):
    built = table(spark, sf, "nation").select(
        "n_nationkey",
        F.explode(
            F.create_map(F.lit("machine"), _nation_key(False), F.lit("display"), _nation_key(True))
        ).alias("form", "key"),
    )
    parsed = built.withColumn("p", keys.parse_key(C("key")))
    return parsed.select(
        "n_nationkey", "form", F.array_join("p.qualifiers", ",").alias("qualifiers"),
        F.explode("p.fields").alias("f"),
    ).select(
        "n_nationkey", "form", "qualifiers", C("f.name").alias("field"),
        F.array_join("f.values", ",").alias("parts"),
    )


# --- enumerations ------------------------------------------------------------

PRIORITY = Enumeration.of(
    "Priority", increasing=False, URGENT=1, HIGH=2, MEDIUM=3, UNSPECIFIED=4, LOW=5
)


def _raw_label():
    text = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    return F.when(C("o_orderpriority") == "4-NOT SPECIFIED", F.lit("unspecified")).otherwise(text)


CODE_SQL = "CAST(left(o_orderpriority, 1) AS INT)"
LABEL_SQL = f"['URGENT', 'HIGH', 'MEDIUM', 'UNSPECIFIED', 'LOW'][{CODE_SQL}]"


@R.add("enum_cast", f"""SELECT o_orderkey, {CODE_SQL} AS code, {LABEL_SQL} AS label,
  CASE WHEN o_orderstatus = 'F' THEN {CODE_SQL} END AS nullable, 'Priority.' || {LABEL_SQL} AS qualified,
  {CODE_SQL} AS from_qualified, CASE WHEN {CODE_SQL} < 3 THEN 1 WHEN {CODE_SQL} = 3 THEN 0 ELSE -1 END AS versus_medium
FROM orders""")
def enum_cast(spark, sf):
    code = PRIORITY.cast(_raw_label())
    orders = table(spark, sf, "orders").withColumn("code", code)
    return orders.select(
        "o_orderkey", "code",
        PRIORITY.label_of(C("code")).alias("label"),
        PRIORITY.cast(F.when(C("o_orderstatus") == "F", _raw_label()), nullable=True).alias("nullable"),
        PRIORITY.qualified(C("code")).alias("qualified"),
        PRIORITY.from_qualified(PRIORITY.qualified(C("code"))).alias("from_qualified"),
        PRIORITY.compare(C("code"), F.lit(3)).alias("versus_medium"),
    )


@R.add("enum_map", f"""SELECT o_orderkey, lower({LABEL_SQL}) AS transformed, {LABEL_SQL} AS swapped,
  {LABEL_SQL} AS labelled, 5::BIGINT AS members FROM orders""")
def enum_map(spark, sf):
    code = C("code")
    orders = table(spark, sf, "orders").withColumn("code", PRIORITY.code_of(_raw_label()))
    inverse = PRIORITY.as_map(transform=str.lower, inverse=True)
    label = F.try_element_at(PRIORITY.as_map(swap=True), code)
    return orders.select(
        "o_orderkey",
        F.try_element_at(inverse, code).alias("transformed"),
        label.alias("swapped"),
        F.try_element_at(PRIORITY.as_map(labels=True), label).alias("labelled"),
        big(F.size(F.map_keys(PRIORITY.as_map()))).alias("members"),
    )


@R.add("enum_minmax", f"""SELECT o_custkey, max({CODE_SQL}) AS lowest, min({CODE_SQL}) AS highest,
  max({CODE_SQL}) FILTER (WHERE o_orderstatus = 'F') AS lowest_done FROM orders GROUP BY 1""")
def enum_minmax(spark, sf):
    orders = table(spark, sf, "orders").withColumn("code", PRIORITY.code_of(_raw_label()))
    done = F.when(C("o_orderstatus") == "F", C("code"))
    return orders.groupBy("o_custkey").agg(
        PRIORITY.minimum(C("code"), nullable=False).alias("lowest"),
        PRIORITY.maximum(C("code"), nullable=False).alias("highest"),
        PRIORITY.minimum(done).alias("lowest_done"),
    )


@R.add("enum_consolidate", f"""SELECT o_custkey, bit_or({CODE_SQL})::INT AS combined,
  CASE WHEN bit_xor({CODE_SQL}) = 0 THEN 8 ELSE bit_xor({CODE_SQL}) END::INT AS parity FROM orders GROUP BY 1""")
def enum_consolidate(spark, sf):
    """One merge that ignores repetition and one that does not."""
    flags = Enumeration.of("Flags", **{f"F{i}": i for i in range(8)})
    orders = table(spark, sf, "orders").withColumn("code", PRIORITY.code_of(_raw_label()))
    combined = flags.consolidate(orders, ["o_custkey"], "code", lambda a, b: a.bitwiseOR(b))
    parity = flags.consolidate(orders, ["o_custkey"], "code", lambda a, b: a.bitwiseXOR(b))
    shown = F.when(C("parity") == 0, F.lit(8)).otherwise(C("parity"))
    return combined.withColumnRenamed("code", "combined").join(
        parity.withColumnRenamed("code", "parity"), "o_custkey"
    ).select("o_custkey", "combined", shown.alias("parity"))

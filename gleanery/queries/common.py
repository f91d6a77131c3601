"""What the registered queries share: tables, derived inputs, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.urls import derive_domain
from gleanery.operators.html import with_nodes
from gleanery.operators.ordered import row_positions
from gleanery.session import spread

Query = Callable[[SparkSession, str], DataFrame]

PAGE_SIZE = 20
NOW = "2024-01-31 00:00:00"


class Registry:
    """Query functions by name, each with the SQL it must agree with, if any."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to be worked on row by row at some cost: use every core."""
    return spread(table(spark, sf_dir, name))


def big(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nodes(work_table(spark, sf_dir, "pages"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, domain``: no page is parsed for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("domain", F.coalesce(derive_domain(F.col("url")), F.lit("")))


def status_of(event_type: Column) -> Column:
    """Stand-in status of an event."""
    codes = {"error": 1, "view": 2, "signup": 3, "click": 4, "purchase": 5}
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), event_type)


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as status writes: a user is a search, ``k`` names the provider."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("search_key"),
        F.concat(F.lit("p"), (k % 8).cast("string")).alias("provider"),
        status_of(F.col("event_type")).alias("status"),
        F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("version"),
        "value",
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer lists as result pages: per nation, 20 rows a page, next-page links.

    Rows are numbered within the nation first, so a page gathers at most 20 rows.
    """
    customers = table(spark, sf_dir, "customer")
    placed = row_positions(
        customers, ["c_nationkey"], [F.col("c_custkey")], None, "pos", "n"
    )
    paged = placed.withColumns(
        {
            "page": F.floor((F.col("pos") - 1) / PAGE_SIZE) + 1,
            "last": F.floor((F.col("n") - 1) / PAGE_SIZE) + 1,
            "row": F.format_string(
                '<li class="entry"><h3><a href="/customer/%s">%s</a></h3>'
                '<p data-kind="%s %s">x</p><em> seg <b>%s</b></em></li>',
                "c_custkey", "c_name", "c_mktsegment", "c_custkey", "c_mktsegment",
            ),
        }
    )
    pages = paged.groupBy("c_nationkey", "page", "last").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda r: r["row"]
            ),
            "",
        ).alias("rows")
    )
    path = F.format_string("/list/%s/%s", "c_nationkey", F.col("page") + 1)
    link = F.when(
        F.col("page") < F.col("last"), F.concat(F.lit('<a rel="next" href="'), path, F.lit('">more</a>'))
    ).otherwise("")
    html = F.concat(
        F.format_string(
            '<html><head><meta name="heading" content="Customers of %s">'
            '<meta name="keeper" content="A%s"><meta name="keeper" content="B%s">'
            '</head><body><div id="list-%s"><ol class="plain entries">',
            "c_nationkey", "c_nationkey", "page", "c_nationkey",
        ),
        "rows",
        F.lit('</ol></div><nav id="turn"><span>'),
        F.col("page").cast("string"),
        F.lit("</span>"),
        link,
        F.lit("</nav></body></html>"),
    )
    return pages.select(
        F.col("c_nationkey").cast("bigint").alias("site"),
        "page",
        F.format_string("https://list.example.com/list/%s/%s", "c_nationkey", "page").alias("url"),
        html.alias("html"),
    )


# Customers as the listing pages hold them.
LISTED_SQL = f"""
listed AS (
  SELECT *, (pos - 1) // {PAGE_SIZE} + 1 AS page, (n - 1) // {PAGE_SIZE} + 1 AS last,
         (pos - 1) % {PAGE_SIZE} + 1 AS idx
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos,
               count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer))"""

HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
TITLE_SQL = (
    "trim(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), "
    "'&amp;?', '&', 'g'), '&quot;', '\"'))"
)
H1_SQL = (
    "trim(replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), "
    "'&amp;?', '&', 'g'), '&quot;', '\"'))"
)
AD_SQL = (
    "trim(replace(regexp_replace(regexp_replace(regexp_extract(html, "
    "'<div class=\"ad\">([^<]*)</div>', 1), '\\s+', ' ', 'g'), '&amp;?', '&', 'g'), '&quot;', '\"'))"
)

# One row per navigation link: its page, position, target and text.
LINKS_SQL = """
links AS (
  SELECT page_id, url,
         unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
         unnest(range(1, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) + 1))
           AS idx
  FROM pages)"""

# A link's path in the normal form of addresses: what is beyond ASCII is escaped, slashes and commas stay.
HREF_SQL = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"

STATUS_SQL = """
log AS (
  SELECT event_id, ts, user_id AS search_key, 'p' || (k % 8) AS provider,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3
           WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 END AS status,
         CASE WHEN k % 3 > 0 THEN 'v' || (k % 3) END AS version, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

# Merged extraction info: newest non-null value per field.
INFO_SQL = STATUS_SQL + """,
info AS (
  SELECT search_key, provider,
         last(status ORDER BY ts, event_id) AS status,
         last(ts ORDER BY ts, event_id) FILTER (WHERE status <> 3) AS last_extracted,
         last(version ORDER BY ts, event_id) FILTER (WHERE version IS NOT NULL) AS cache_version
  FROM log GROUP BY ALL)"""

LABEL_SQL = (
    "CASE status WHEN 1 THEN 'FAILURE' WHEN 2 THEN 'EMPTY' WHEN 3 THEN 'INITIATED' "
    "WHEN 4 THEN 'PRELIMINARY' WHEN 5 THEN 'COMPLETED' END"
)
REUSE_SQL = f"""coalesce(status >= 4
  AND floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_extracted)) / 86400000000.0) < 15
  AND cache_version IS NOT DISTINCT FROM 'v1', false)"""

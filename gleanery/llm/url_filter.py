"""URL rules by host suffix and path prefix, found with short hash prefixes.

Each URL is expanded into expressions ``host suffix + path folder`` and joined with the
rules' expressions by the first four bytes of their SHA-256. Full digests and
the rest of the rule's path are compared afterwards, and the longest fitting rule wins.

A rule's expression is its host and its path up to the last ``/``, so a rule may
end inside a path segment. Defined cases: a null URL or one without ``://`` has an
empty host and path and fits only rules with an empty host; equal rules count once and a
tie between a block and an allow rule of one host and path is a block; of rules of one length,
which then differ in where the host ends, the longer host wins; an empty rule table leaves
every verdict to ``default``. Repeated pages are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import is_small

#: Copies of each rule when the rules are too many to send everywhere, so that a host
#: that holds a third of all pages is spread over so many tasks.
SALT = 32
RULES = "verdict string, rule_host string, rule_path string"
PREFIX_BYTES = 4


def _lowered(host: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def _folders(path: Column) -> Column:
    """The empty prefix and every prefix that ends in a slash."""
    parts = F.split(path, "/", -1)
    slashes = F.size(parts) - 1
    return F.transform(
        F.sequence(F.lit(0), slashes),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 2 * PREFIX_BYTES), 16, 10).cast("bigint")


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their expression's short prefix and full digest."""
    path = F.coalesce("rule_path", F.lit(""))
    host = _lowered(F.coalesce("rule_host", F.lit("")))
    once = rules.select(host.alias("rule_host"), path.alias("rule_path"), "verdict")
    once = once.groupBy("rule_host", "rule_path").agg(F.max(F.col("verdict") == "block").alias("_blocks"))
    digest = _digest(F.col("rule_host"), F.regexp_extract("rule_path", "^(.*/)?", 0))
    return once.withColumn("_full", digest).withColumn("_short", _short(F.col("_full")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page, by the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Pages that share host and path share the answer: each pair is expanded once.
    places = rows.select("host", "path").distinct()
    expressions = places.select("host", "path", F.explode(_host_suffixes(F.col("host"))).alias("_host"))
    expressions = expressions.select(
        "host", "path", "_host", F.explode(_folders(F.col("path"))).alias("_folder")
    ).select("host", "path", _digest(F.col("_host"), F.col("_folder")).alias("_place"))
    expressions = expressions.withColumn("_short", _short(F.col("_place")))
    known = prepared(rules)
    if is_small(known):
        met = expressions.join(F.broadcast(known), "_short")
    else:
        salted = expressions.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int"))
        copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = salted.join(copies, ["_short", "_salt"])
    fits = met.filter((F.col("_place") == F.col("_full")) & F.startswith("path", "rule_path"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"),
        F.length("rule_host").alias("h"),
        F.col("rule_host").alias("rule_host"),
        F.col("rule_path").alias("rule_path"),
        F.col("_blocks").alias("blocks"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.blocks"), "block").otherwise("allow")
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.concat("_best.rule_host", "_best.rule_path").alias("rule"),
        verdict.alias("verdict"),
    )

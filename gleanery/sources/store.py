"""Keyed content store: field-wise upserts, ranked indexes, extraction info.

The store is a log of batches in a shared folder. A batch is first reduced to one
row per key, then written to a folder named by its writer and its number, so a
repeated batch replaces itself and no other writer's batch is touched. Reading
merges the log; since the newest non-null value per field wins, merging is one
aggregation and can be folded back into a log at any time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.dates import deserialize_granular
from gleanery.functions.keys import build_key, key_field
from gleanery.functions.records import iso_text
from gleanery.operators.status import INITIATED, STATUS

# The words composite keys start with.
CONTENT, EXTRACTION, INFO, RESULTS = "content", "extraction", "info", "results"


def content_key(source_url: Column) -> Column:
    return build_key(F.array(F.lit(CONTENT)), F.array(key_field("source_url", source_url)))


def _search_fields(search_data: Column) -> Column:
    return F.transform(
        search_data, lambda t: F.struct(t["topic"].alias("name"), t["terms"].alias("values"))
    )


def results_key(search_data: Column, provider: Column | None = None) -> Column:
    """Key of a search's ranked index, over all providers or for one."""
    fields = _search_fields(search_data)
    if provider is not None:
        fields = F.concat(F.array(key_field("extractor", provider)), fields)
    return build_key(F.array(F.lit(EXTRACTION), F.lit(RESULTS)), fields)


def info_key(search_data: Column, provider: Column) -> Column:
    fields = F.concat(F.array(key_field("extractor", provider)), _search_fields(search_data))
    return build_key(F.array(F.lit(EXTRACTION), F.lit(INFO)), fields)


def merge_fields(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest non-null value of every field, per key.

    ``order`` must rank the rows of a key without ties. Each field is its own
    ``max_by``, which merges partially on the map side: a key with very many
    versions sends one row per task.
    """
    at = "struct(" + ", ".join(f"`{o}`" for o in order) + ")"
    fields = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(
        *[F.expr(f"max_by(`{f}`, CASE WHEN `{f}` IS NOT NULL THEN {at} END) AS `{f}`") for f in fields],
        *[F.expr(f"max({at}).`{o}` AS `{o}`") for o in order],
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows with later writes laid over them; null fields overwrite nothing.

    A merged row keeps one order value for all its fields, so ``new`` must be
    later than ``old``. Where writes may arrive out of order, use ``KeyedStore``.
    """
    return merge_fields(old.unionByName(new, allowMissingColumns=True), keys, order)


def prepare_content(items: DataFrame, version: Column, now: Column) -> DataFrame:
    """Stamp version and time; ranks belong to the index, not to the content."""
    return items.withColumns({"_cache_version": version, "_last_extracted": now}).drop("rank")


def rank_index(results: DataFrame, keys: list[str], member: str, rank: str, order: list[str]) -> DataFrame:
    """Rank of every member of an index; the last score written wins."""
    return results.groupBy(*keys, member).agg(
        F.max_by(rank, F.struct(*order)).alias(rank), F.max(F.struct(*order)).alias("_at")
    ).select(*keys, member, rank, *[F.col("_at")[o].alias(o) for o in order])


def lookup(keys: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """Content of each requested key; a key without content gets nulls."""
    return keys.join(content, key, "left")


def ranked_content(index: DataFrame, content: DataFrame, key: str, rank: str) -> DataFrame:
    """Index members with their content, by score, ties by member."""
    return index.join(content, key, "left").orderBy(rank, key)


def content_map(index: DataFrame, content: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Index members that have content, and those that should but do not."""
    return index.join(content, key), index.join(content.select(key), key, "left_anti")


def info_updates(writes: DataFrame, status: str, at: str, version: str) -> DataFrame:
    """What one status write stores: no time while only initiated, no empty version."""
    return writes.withColumns(
        {
            "last_extracted": F.when(F.col(status) != INITIATED, F.col(at)),
            "cache_version": F.nullif(F.col(version), F.lit("")),
        }
    )


def info_to_hash(status: Column, last_extracted: Column, cache_version: Column) -> Column:
    """Extraction info as stored: a string map without its null entries."""
    entries = F.create_map(
        F.lit("status"), STATUS.label_of(status),
        F.lit("last_extracted"), iso_text(last_extracted),
        F.lit("cache_version"), cache_version,
    )
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def info_from_hash(hashed: Column) -> list[Column]:
    """Extraction info read back; absent entries and unknown statuses are null."""
    entry = lambda name: F.try_element_at(hashed, F.lit(name))
    return [
        STATUS.code_of(entry("status")).alias("status"),
        deserialize_granular(entry("last_extracted"))["ts"].alias("last_extracted"),
        entry("cache_version").alias("cache_version"),
    ]


class KeyedStore:
    """The log of one kind of rows.

    Every stored field carries the order of the write it came from, so merging
    gives the same rows whatever the order batches arrive in or are folded.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: T.StructType):
        self.spark, self.path, self.keys, self.order, self.schema = spark, path, keys, order, schema
        self.fields = [f.name for f in schema if f.name not in (*keys, *order)]

    def _stamped(self, rows: DataFrame) -> DataFrame:
        at = F.struct(*self.order)
        return rows.select(
            *self.keys,
            at.alias("_at"),
            *[
                F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("value"))).alias(f)
                for f in self.fields
            ],
        )

    def _merged(self, stamped: DataFrame) -> DataFrame:
        return stamped.groupBy(*self.keys).agg(
            F.max("_at").alias("_at"),
            *[F.max_by(F.col(f), F.col(f)["at"]).alias(f) for f in self.fields],
        )

    def append(self, rows: DataFrame, batch: int, writer: str = "direct") -> None:
        """Add a writer's batch; the same writer adding the same batch again replaces it."""
        self._write(self._merged(self._stamped(rows)), f"{writer}-{batch}")

    def _write(self, merged: DataFrame, name: str) -> None:
        merged.write.mode("overwrite").parquet(f"{self.path}/batch={name}")

    def log(self, batches: list[str] | None = None) -> DataFrame:
        """Stored rows as written, of some batches by name or of all; none while nothing is stored."""
        stamped = self._stamped(self.spark.createDataFrame([], self.schema))
        if batches is not None:
            paths = [f"{self.path}/batch={name}" for name in batches]
            return self.spark.read.schema(stamped.schema).parquet(*paths) if paths else stamped
        try:
            return self.spark.read.schema(stamped.schema).parquet(f"{self.path}/batch=*")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return stamped

    def read(self, batches: list[str] | None = None) -> DataFrame:
        """One merged row per key."""
        merged = self._merged(self.log(batches))
        return merged.select(
            *self.keys,
            *[F.col(f)["value"].alias(f) for f in self.fields],
            *[F.col("_at")[o].alias(o) for o in self.order],
        )

    def fold(self, batches: list[str], name: str) -> None:
        """The merged rows of some batches as one more batch."""
        self._write(self._merged(self.log(batches)), name)

    def compact(self, path: str) -> KeyedStore:
        """The merged rows as a batch of another log, under a name that no writer has."""
        store = KeyedStore(self.spark, path, self.keys, self.order, self.schema)
        store._write(self._merged(self.log()), f"folded-{uuid.uuid4().hex}")
        return store

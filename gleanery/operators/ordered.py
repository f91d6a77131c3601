"""Ordered computations per key that stay parallel inside a hot key.

A plain window puts a whole key into one task. Here each key is cut into chunks
of consecutive order values. Rows are numbered, summed or compared inside (key, chunk); the few values
that must cross chunk borders travel on one summary row per (key, chunk). A null key
is a key like any other.

Without ``chunk`` the table is cut at sampled borders of (key, order) into ranges of about equal size,
whatever the type and spread of the order; so no key and no burst of order values fills one task. Where
the order is a number known to run without gaps, ``chunk`` saves that pass: any column that never decreases
along the order, such as ``id_chunk``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.session import cut_lineage

CHUNK_ROWS = 1 << 18


def id_chunk(order: Column, width: int = CHUNK_ROWS) -> Column:
    """Chunk of a unique integer order without gaps: at most ``width`` rows each."""
    return F.floor(order / width)


def _chunked(df: DataFrame, keys: list[str], order: list, chunk: Column | None) -> DataFrame:
    """Rows with their ``_chunk``. Ranges are written: their borders are sampled, and the rows are read twice."""
    if chunk is not None:
        return df.withColumn("_chunk", chunk)
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))


def _borders(summary: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Per-chunk values carried in from all earlier chunks of the key."""
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return summary.select(
        *keys, "_chunk", *[v.over(before).alias(name) for name, v in values.items()]
    )


def _attach(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """Join on (key, chunk), null keys included: the rows keep the partitioning of their window."""
    named = borders.withColumnsRenamed({c: f"_border_{c}" for c in (*keys, "_chunk")})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_border_{c}")) for c in (*keys, "_chunk")])
    return rows.join(named, match, "left").drop(*[f"_border_{c}" for c in (*keys, "_chunk")])


def row_positions(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None,
                  name: str, size: str | None = None) -> DataFrame:
    """1-based position of each row within its key, and the key's row count on request."""
    rows = _chunked(df, keys, order, chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    summary = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    borders = _borders(summary, keys, {"_before": F.sum("_n")})
    if size:
        counted = summary.withColumn("_size", F.sum("_n").over(W.partitionBy(*keys)))
        before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        borders = counted.select(
            *keys, "_chunk", F.sum("_n").over(before).alias("_before"), "_size"
        )
    numbered = rows.withColumn("_local", F.row_number().over(inside))
    out = _attach(numbered, borders, keys).withColumn(
        name, F.col("_local") + F.coalesce("_before", F.lit(0))
    )
    return (out.withColumnRenamed("_size", size) if size else out).drop("_local", "_before", "_chunk")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None,
                value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the key's first row up to and including each row."""
    rows = _chunked(df, keys, order, chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    summary = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    borders = _borders(summary, keys, {"_before": F.sum("_total")})
    summed = rows.withColumn("_local", F.sum(value).over(inside))
    zero = F.lit(0).cast(df.schema[value].dataType)
    return (
        _attach(summed, borders, keys)
        .withColumn(name, F.col("_local") + F.coalesce("_before", zero))
        .drop("_local", "_before", "_chunk")
    )


def running_max(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None,
                value: str, name: str, including_row: bool = True) -> DataFrame:
    """Largest ``value`` so far in the key, with or without the row itself."""
    rows = _chunked(df, keys, order, chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow if including_row else -1
    )
    summary = rows.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    borders = _borders(summary, keys, {"_before": F.max("_top")})
    local = rows.withColumn("_local", F.max(value).over(inside))
    return (
        _attach(local, borders, keys)
        .withColumn(name, F.greatest("_local", "_before"))
        .drop("_local", "_before", "_chunk")
    )


def previous_row(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None,
                 columns: list[str], name: str) -> DataFrame:
    """The row before, as a struct of ``columns``; null on a key's first row."""
    rows = _chunked(df, keys, order, chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*columns)
    summary = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(packed, F.struct(*order)).alias("_last")
    )
    nearest = W.partitionBy(*keys).orderBy("_chunk")
    borders = summary.select(*keys, "_chunk", F.lag("_last").over(nearest).alias("_before"))
    local = rows.withColumn("_local", F.lag(packed).over(inside))
    return (
        _attach(local, borders, keys)
        .withColumn(name, F.coalesce("_local", "_before"))
        .drop("_local", "_before", "_chunk")
    )

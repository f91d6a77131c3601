"""Counts per group held against bounds; changed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.records import rows_equal


def bounds(exact: int | None = None, minimum: int | None = None,
           maximum: int | None = None) -> tuple[int, int | None]:
    if exact is not None:
        if minimum is not None or maximum is not None:
            raise ValueError("exact excludes minimum and maximum")
        return exact, exact
    low = 0 if minimum is None else minimum
    if maximum is not None and low > maximum:
        raise ValueError(f"minimum {low} is greater than maximum {maximum}")
    return low, maximum


def outcome(count: Column, low: int, high: int | None) -> Column:
    """``ok``, ``too few`` or ``too many``."""
    result = F.when(count < low, F.lit("too few"))
    if high is not None:
        result = result.when(count > high, F.lit("too many"))
    return result.otherwise(F.lit("ok"))


def constrain(rows: DataFrame, keys: list[str], exact: int | None = None,
              minimum: int | None = None, maximum: int | None = None,
              strict: bool = False) -> DataFrame:
    """Row count and outcome per group; ``strict`` fails on the first breach.

    Groups are counted by partial aggregation, so a hot group costs one number
    per task.
    """
    low, high = bounds(exact, minimum, maximum)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("received"))
    result = counted.withColumn("outcome", outcome(F.col("received"), low, high))
    if strict:
        expected = str(low) if low == high else f"{low}-{'inf' if high is None else high}"
        reason = F.concat(F.col("outcome"), F.lit(f" values: expected {expected}, received "),
                          F.col("received").cast("string"))
        result = result.withColumn(
            "outcome", F.when(F.col("outcome") == "ok", F.lit("ok")).otherwise(
                F.raise_error(reason).cast("string"))
        )
    return result


def one(rows: DataFrame, keys: list[str], value: str, at_most: bool = False) -> DataFrame:
    """The only value of each group, with the outcome; no value where there are more."""
    low, high = (0, 1) if at_most else (1, 1)
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.min(value).alias("_value")
    )
    single = F.when(F.col("received") == 1, F.col("_value"))
    return counted.select(
        *keys, "received", outcome(F.col("received"), low, high).alias("outcome"),
        single.alias(value),
    )


def at_least_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    return constrain(rows, keys, minimum=1)


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose fields differ between two versions, absence included."""
    fields = [c for c in old.columns if c != key]
    left = old.select(key, F.struct(*fields).alias("_old"))
    right = new.select(key, F.struct(*fields).alias("_new"))
    both = left.join(right, key, "full")
    same = rows_equal(
        [F.col("_old")[f] for f in fields], [F.col("_new")[f] for f in fields]
    ) & (F.col("_old").isNull() == F.col("_new").isNull())
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .otherwise(F.lit("changed"))
    )
    return both.filter(~same).select(key, change.alias("change"), "_old", "_new")

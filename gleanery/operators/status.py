"""Extraction status: freshness, roll-ups, transitions, outstanding work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.enums import Enumeration
from gleanery.operators.ordered import previous_row

# Status codes, allowed changes, freshness thresholds in days.
STATUS = Enumeration.of(
    "ExtractionStatus", FAILURE=1, EMPTY=2, INITIATED=3, PRELIMINARY=4, COMPLETED=5
)
FAILURE, EMPTY, INITIATED, PRELIMINARY, COMPLETED = 1, 2, 3, 4, 5
TRANSITIONS = {
    FAILURE: (INITIATED,),
    EMPTY: (INITIATED,),
    INITIATED: (PRELIMINARY, FAILURE, EMPTY),
    PRELIMINARY: (COMPLETED,),
    COMPLETED: (PRELIMINARY,),
}
FRESH_DAYS = {"base": float("inf"), "multi": 30.0, "source": 365.0}

MICROS_PER_DAY = 86_400_000_000


def days_since(then: Column, now: Column) -> Column:
    """Whole days, rounded down, also for times in the future."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.floor(micros / MICROS_PER_DAY).cast("bigint")


def reusable(status: Column, last_extracted: Column, cache_version: Column, now: Column,
             threshold: Column | float, version: Column, use_cache: bool = True) -> Column:
    """Whether stored content may be used: dated, far enough, fresh, same version."""
    if not use_cache:
        return F.lit(False)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    fresh = days_since(last_extracted, now) < limit
    ok = (status >= PRELIMINARY) & fresh & cache_version.eqNullSafe(version)
    return F.coalesce(ok, F.lit(False))


def reusable_source(last_extracted: Column, cache_version: Column, now: Column,
                    version: Column, threshold: float = FRESH_DAYS["source"]) -> Column:
    """Stored source content counts as completed."""
    return reusable(F.lit(COMPLETED), last_extracted, cache_version, now, threshold, version)


def rolled_up(lowest: Column, highest: Column) -> Column:
    """Status of a cohort from its lowest and highest member."""
    return (
        F.when(lowest == COMPLETED, F.lit(COMPLETED))
        .when(highest >= PRELIMINARY, F.lit(PRELIMINARY))
        .otherwise(highest)
    )


def roll_up(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """One status per cohort; null when no member has one."""
    code = F.col(status)
    ends = rows.groupBy(*keys).agg(STATUS.minimum(code).alias("_lo"), STATUS.maximum(code).alias("_hi"))
    return ends.select(*keys, rolled_up(F.col("_lo"), F.col("_hi")).cast("int").alias("status"))


def provider_info(plan: DataFrame, info: DataFrame, keys: list[str]) -> DataFrame:
    """Extraction info of every planned (search, provider); nulls where there is none."""
    return plan.join(info, keys, "left")


def overall_status(plan: DataFrame, keys: list[str], reuse: Column, provider: str = "provider",
                   status: str = "status") -> DataFrame:
    """What to answer for a search, from the info of its active providers.

    Completed if all are reusable, which holds for no providers too: such a
    search has a row without a provider.
    """
    code = F.col(status)
    usable = F.coalesce(reuse, F.lit(False)) | F.col(provider).isNull()
    ends = plan.groupBy(*keys).agg(
        F.bool_and(usable).alias("_all"),
        STATUS.minimum(code).alias("_lo"),
        STATUS.maximum(code).alias("_hi"),
    )
    rolled = rolled_up(F.col("_lo"), F.col("_hi"))
    answer = (
        F.when(F.col("_all"), F.lit(COMPLETED))
        .when(rolled.isNull(), F.lit(INITIATED))
        .when(rolled >= PRELIMINARY, F.lit(PRELIMINARY))
        .otherwise(rolled)
    )
    return ends.select(*keys, answer.cast("int").alias("status"))


def cohort_statuses(info: DataFrame, keys: list[str], provider: str, status: str) -> DataFrame:
    """Status values of a search's providers, in provider order.

    ``info`` holds one row per search and provider, so a list is never longer
    than the provider catalog.
    """
    entries = F.array_sort(F.collect_list(F.struct(provider, status)))
    return info.groupBy(*keys).agg(F.transform(entries, lambda e: e[status]).alias("statuses"))


def current_status(log: DataFrame, keys: list[str], order: list[str], status: str = "status") -> DataFrame:
    """Latest status per extraction."""
    return log.groupBy(*keys).agg(
        F.max_by(F.col(status), F.struct(*order)).alias(status), F.count(F.lit(1)).alias("changes")
    )


def is_legal(before: Column, after: Column) -> Column:
    """Whether a status may follow another; anything but a first start needs a past.

    A repeated status is no change and always allowed.
    """
    test = before.isNull() & (after == INITIATED)
    for source, targets in TRANSITIONS.items():
        test = test | ((before == source) & after.isin(*targets))
    return F.coalesce(test | (before == after), F.lit(False))


def status_changes(log: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None,
                   status: str = "status") -> DataFrame:
    """Each log entry with the status before it and whether the step is legal."""
    paired = previous_row(log, keys, order, chunk, [status], "_previous")
    before = F.col("_previous")[status]
    return paired.withColumn("previous", before).withColumn(
        "legal", is_legal(before, F.col(status))
    ).drop("_previous")


def start_status(previous: Column) -> Column:
    """Status to write when an extraction starts: a finished one re-opens as preliminary."""
    return F.when(previous >= PRELIMINARY, F.lit(PRELIMINARY)).otherwise(F.lit(INITIATED))


def outstanding(plan: DataFrame, info: DataFrame, keys: list[str], reuse: Column) -> DataFrame:
    """(search, provider) pairs of a plan without reusable content."""
    return plan.join(info.filter(reuse).select(*keys), keys, "left_anti")

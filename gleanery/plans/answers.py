"""Answers to searches from what is stored, for many searches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.status import PRELIMINARY, STATUS, overall_status, provider_info


def answer_searches(plan: DataFrame, info: DataFrame, index: DataFrame, content: DataFrame,
                    search: str, member: str, reuse: Column) -> DataFrame:
    """Status of every search, its ranked content, and its number of open extractions.

    Content is attached once a search is preliminary; one row per content item, or
    one row without content. ``plan`` holds the active (search, provider) pairs.
    """
    keys = [search, "provider"]
    known = provider_info(plan, info, keys)
    statuses = overall_status(known, [search], reuse)
    open_work = known.groupBy(search).agg(
        F.count_if(~F.coalesce(reuse, F.lit(False)) & F.col("provider").isNotNull()).alias("outstanding")
    )
    answers = statuses.join(open_work, search)
    ready = answers.filter(F.col("status") >= PRELIMINARY)
    # The content rows are the large side and meet one status row each, so a search
    # with very many items can be split; searches without items follow separately.
    found = index.join(content, member, "left").join(ready, search)
    empty = ready.join(index.select(search).distinct(), search, "left_anti")
    waiting = answers.filter(F.col("status") < PRELIMINARY)
    bare = empty.unionByName(waiting)
    return found.unionByName(bare, allowMissingColumns=True).withColumn(
        "status", STATUS.label_of(F.col("status"))
    )

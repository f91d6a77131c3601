"""Streamed extraction: arriving result pages become content, ranked indexes and extraction info, all in one commit.

Rows arrive as files of result pages, each with its search, its provider, its page number and when it was fetched. Every
batch is parsed once, extracted by its sites' definitions and committed to four stores together, so an
answer never shows an index entry whose content is not there. All four merge by the time and place of what they hold,
so it does not matter how pages fall into batches, in which order they come, or whether a batch is run again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.records import Model
from gleanery.functions.urls import normalize_url, resolve_link
from gleanery.operators.html import with_nodes
from gleanery.operators.items import valid_items
from gleanery.operators.status import COMPLETED, EMPTY, FAILURE
from gleanery.plans.extraction import Provider, items_of
from gleanery.plans.refresh import by_provider, extracted_by_each
from gleanery.session import cut_lineage, scratch_path
from gleanery.sources.commits import StoreGroup

CONTENT, SEARCH_INDEX, PROVIDER_INDEX, INFO = "content", "search_index", "provider_index", "info"
ARRIVING = "search_key bigint, provider string, page int, url string, html string, fetched_at timestamp_ntz"
#: What orders the writes of one address: later fetches, then later pages and places, lay over earlier ones.
ORDER = ["fetched_at", "provider", "page", "index", "search_key", "url"]


def extraction_stores(spark: SparkSession, path: str, model: Model) -> StoreGroup:
    """The four stores of an extraction below one folder."""
    fields = [f for f in model.fields if f.name not in ("source_url", "rank")]
    order = "fetched_at timestamp_ntz, provider string, page int, index int, search_key bigint, url string"
    schema = lambda text: spark.createDataFrame([], text).schema
    named = ", ".join(f"`{f.name}` {f.sql_type}" for f in fields)
    ranked = "fetched_at timestamp_ntz, page int, index int"
    return StoreGroup(spark, path, {
        CONTENT: (["source_url"], ORDER, schema(f"source_url string, {named}, _cache_version string, {order}")),
        SEARCH_INDEX: (
            ["search_key", "source_url"], ["fetched_at", "page", "index", "provider"],
            schema(f"search_key bigint, source_url string, rank bigint, {ranked}, provider string"),
        ),
        PROVIDER_INDEX: (
            ["search_key", "provider", "source_url"], ["fetched_at", "page", "index"],
            schema(f"search_key bigint, provider string, source_url string, rank bigint, {ranked}"),
        ),
        INFO: (
            ["search_key", "provider"], ["found", "last_extracted"],
            schema("search_key bigint, provider string, status int, cache_version string, found int, last_extracted timestamp_ntz"),
        ),
    })


def extracted(pages: DataFrame, providers: dict[str, Provider], model: Model) -> dict[str, DataFrame]:
    """Rows for the four stores from result pages, in batch or streamed.

    A pair's info is that of its best page: with content, else with items that have no address, else without any; of
    equal ones the latest. Pages of unknown providers are left out.
    """
    known = pages.filter(F.col("provider").isin(sorted(providers)))
    # A page beyond its site's last holds no items and is no visit: it is not parsed.
    known = known.filter(F.col("page") <= by_provider(providers, lambda p: p.pages, "bigint"))
    path = scratch_path(pages.sparkSession, "arrived")
    # Parsing costs by the page, not by the bytes shuffled: few sites are cut so that every core has pages of some.
    cuts = -(-2 * pages.sparkSession.sparkContext.defaultParallelism // max(1, len(providers)))
    parsed = with_nodes(known.repartition("provider", F.pmod(F.xxhash64("url"), F.lit(cuts))))
    parsed.write.partitionBy("provider").parquet(path)
    parsed = pages.sparkSession.read.schema(parsed.schema).parquet(path)
    items = extracted_by_each(providers, parsed, "provider", lambda rows, site: items_of(rows, site, model))
    items = items.withColumn("source_url", normalize_url(resolve_link(F.col("source_url"), F.col("url")))).drop("_errors")
    valid = valid_items(items)
    version = by_provider(providers, lambda p: p.cache_version, "string")
    fields = [f.name for f in model.fields if f.name not in ("source_url", "rank")]
    content = valid.select("source_url", *fields, version.alias("_cache_version"), *ORDER)
    ranked = valid.select("search_key", "provider", "source_url", F.col("rank").cast("bigint").alias("rank"), "fetched_at", "page", "index")
    found = items.groupBy("search_key", "provider", "page", "url", "fetched_at").agg(
        F.max(F.when(F.coalesce(F.col("source_url"), F.lit("")) != "", 2).otherwise(1)).alias("_found")
    )
    visits = parsed.select("search_key", "provider", "page", "url", "fetched_at").distinct()
    seen = visits.join(found, ["search_key", "provider", "page", "url", "fetched_at"], "left").withColumn("found", F.coalesce("_found", F.lit(0)))
    status: Column = F.when(F.col("found") == 2, COMPLETED).when(F.col("found") == 1, FAILURE).otherwise(EMPTY)
    info = seen.select(
        "search_key", "provider", status.alias("status"), version.alias("cache_version"), "found", F.col("fetched_at").alias("last_extracted")
    )
    return {
        CONTENT: content,
        SEARCH_INDEX: ranked.select("search_key", "source_url", "rank", "fetched_at", "page", "index", "provider"),
        PROVIDER_INDEX: ranked,
        INFO: info,
    }


def stream_extraction(spark: SparkSession, source: str, providers: dict[str, Provider], model: Model, stores: StoreGroup,
                      checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Extract arriving files of result pages and commit every batch to all stores.

    The stream's own id, which its checkpoint keeps, and the batch number name a commit. A batch that is run again
    after a lost driver finds its mark and changes nothing, or finds none and writes its folders anew.
    """
    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    identity: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if not identity:
            # Spark writes the id before the first batch.
            identity.append(json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"])
        rows = extracted(batch, providers, model)
        stores.commit({name: cut_lineage(frame) for name, frame in rows.items()}, number, identity[0])

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

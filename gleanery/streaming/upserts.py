"""Incremental arrival: new files are merged into a keyed store as they come."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources.store import KeyedStore


def stream_into(spark: SparkSession, source: str, schema, store: KeyedStore, checkpoint: str,
                prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Read arriving parquet files and append every batch to the store.

    The stream's own id, which its checkpoint keeps, and the batch number name the
    batch's folder. A batch replayed after a lost driver or executor overwrites
    itself, so each row counts once, and another stream, or one with a renewed
    checkpoint, adds its batches beside those already stored.
    """
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )

    identity: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if not identity:
            # Spark writes the id before the first batch.
            identity.append(json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"])
        store.append(prepare(batch), number, identity[0])

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

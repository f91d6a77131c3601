"""Several stores written as one: a batch counts in all of them or in none.

Each store keeps a batch in a folder of its own. When all are written, one row in the folder of marks names the
batch; that row is one file, which appears whole or not at all. Readers take the batches that have a mark, so
what a lost driver left half written is never seen, and the same batch written again takes its place.
Folding writes the merged rows of all marked batches as one more batch, whose mark also names those it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gleanery.sources.store import KeyedStore

MARKS = "batch string, replaces array<string>"


class StoreGroup:
    """Stores by name below one folder. ``layout`` gives keys, order and schema of each."""

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, tuple[list[str], list[str], T.StructType]]):
        self.spark, self.path = spark, path.rstrip("/")
        self.stores = {n: KeyedStore(spark, f"{self.path}/{n}", *parts) for n, parts in layout.items()}

    def marks(self) -> list[tuple[str, list[str]]]:
        """All marks: a row for each commit since the group began."""
        try:
            rows = self.spark.read.schema(MARKS).parquet(f"{self.path}/marks").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [(r["batch"], r["replaces"]) for r in rows]

    def batches(self) -> list[str]:
        """Marked batches that no later one has replaced."""
        marks = self.marks()
        gone = {name for _, replaced in marks for name in replaced}
        return sorted({name for name, _ in marks} - gone)

    def _mark(self, name: str, replaces: list[str]) -> None:
        self.spark.createDataFrame([(name, replaces)], MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    def commit(self, rows: dict[str, DataFrame], batch: int, writer: str = "direct") -> bool:
        """Add a writer's batch to every store; False where that batch was marked before, which leaves it as it is."""
        if set(rows) != set(self.stores):
            raise ValueError(f"a batch needs rows for each of {sorted(self.stores)}")
        name = f"{writer}-{batch}"
        if name in {known for known, _ in self.marks()}:
            return False
        for store, frame in rows.items():
            self.stores[store].append(frame, batch, writer)
        self._mark(name, [])
        return True

    def read(self, store: str) -> DataFrame:
        """One merged row per key, of the marked batches."""
        return self.stores[store].read(self.batches())

    def fold(self) -> None:
        """Replace all marked batches by one; readers see either those or the one."""
        names = self.batches()
        if len(names) < 2:
            return
        folded = f"folded-{uuid.uuid4().hex}"
        for store in self.stores.values():
            store.fold(names, folded)
        self._mark(folded, names)

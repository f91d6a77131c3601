"""Hard negatives of anchor vectors, by Fagin's threshold algorithm over blocks of vectors.

Vectors are kept as whole numbers, so scores (inner products) are exact. A task holds one block of
vectors with a list for each dimension, sorted by that dimension's value. For an anchor the lists are
read side by side, each from the end that the sign of the anchor's value makes the better one. What a list shows
first is scored at once from its whole vector (random access). The values the lists have come
to bound the score of every vector not seen yet; the search of a block ends when that bound lies strictly below
what is wanted: the kth best score, or, while a window has fewer than k, the window's lower end. A block's best
rows then meet those of the other blocks in a window aggregation that keeps the first k.

An anchor's positives are its best rows of its own label, read from lists of that label alone. Each
positive opens a window of scores below its own; its negatives are the best rows of other labels inside.

Blocks are written to the shared folder once. Anchors are taken in slices of a bounded number
of values, each sent to all tasks in chunks; more anchors mean more slices, not larger ones.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
of rows that share an id the one with the smallest label, then vector, counts; a shorter vector counts as padded with
zeros, so an empty one scores 0 everywhere; ties go to the smaller id; scores beyond 64 bits count as the largest or
smallest long; a positive with a score below 0 has no window; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import mapped, spans
from gleanery.session import cut_lineage, scratch_path

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
BLOCK = 8192
#: Values (components) of the anchors of a chunk, and chunks of a slice: 4,194,304 values, 32 MB, are sent at once.
CHUNK_VALUES, SLICE_CHUNKS = 1 << 16, 64
#: Entries of each list that a first round reads; every round reads twice as many as the one before.
FIRST_ROUND = 64

BLOCKS = "block long, count int, ids binary, labels binary, width int, vectors binary"
ANCHORS = "id long, label long, vector array<long>"
BEST = "anchor_id long, id long, score long"
MET = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

_LONG = np.iinfo(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold them all."""
    for kind in ("<i2", "<i4"):
        bound = np.iinfo(kind)
        if not values.size or (values.min() >= bound.min and values.max() <= bound.max):
            return values.astype(kind).tobytes()
    return values.astype("<i8").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``id, label, vector`` of the rows that take part; components are floor(256 x)."""
    rows = rows.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col(vector).alias("x")
    )
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
    once = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row"))
    whole = F.transform("row.x", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return once.select("id", F.col("row.label").alias("label"), whole.alias("vector"))


def _blocked(batches):
    """Blocks of vectors in the order of their ids."""
    held, count, number = [], 0, 0

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.combine_chunks().sort_by("id")
        lists = rows["vector"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = np.diff(lists.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        vectors = np.zeros((len(lengths), width), np.int64)
        owner, place = spans(lengths)
        vectors[owner, place] = lists.flatten().to_numpy()
        part = rows["part"][0].as_py()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part << 32 | number]), pa.array([len(lengths)], pa.int32()),
                pa.array([_packed(rows["id"].to_numpy())], pa.binary()),
                pa.array([_packed(rows["label"].to_numpy())], pa.binary()), pa.array([width], pa.int32()),
                pa.array([_packed(vectors.ravel())], pa.binary()),
            ],
            names=["block", "count", "ids", "labels", "width", "vectors"],
        )

    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(begin, BLOCK))
            count += held[-1].num_rows
            if count >= BLOCK:
                yield block(pa.Table.from_batches(held), number)
                held, count, number = [], 0, number + 1
    if count:
        yield block(pa.Table.from_batches(held), number)


class Vectors:
    """A block's vectors and, for each dimension, its rows from the largest value to the smallest."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self._floats = vectors.astype(np.float64)
        self._most = int(np.abs(self._floats).max(initial=0))
        self._lists: dict = {}

    def lists(self, label: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, then for each dimension their order and their values in it; of one label or of all."""
        if label not in self._lists:
            rows = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            values = self.vectors[rows].T
            order = np.argsort(-values, axis=1, kind="stable")
            self._lists[label] = rows[order], np.take_along_axis(values, order, 1), rows
        return self._lists[label]

    @classmethod
    def of(cls, row: dict) -> Vectors:
        n, width = row["count"], row["width"]
        flat = _unpacked(row["vectors"], n * width)
        return cls(_unpacked(row["ids"], n), _unpacked(row["labels"], n), flat.reshape(n, width))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where those hold every sum, else in Python's integers."""
        if self._most * int(np.abs(anchor.astype(np.float64)).sum()) < 1 << 52:
            return (self._floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        exact = self.vectors[rows].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(x), _LONG.min), _LONG.max) for x in exact], np.int64)

    def search(self, anchor: np.ndarray, label: int | None, met) -> None:
        """Sorted access in rounds. ``met`` takes the rows first seen in a round, their scores and the
        bound on the scores of all others, and says whether that is enough."""
        lists, values, rows = self.lists(label)
        used = np.flatnonzero(anchor[: len(lists)])
        ahead, behind = used[anchor[used] > 0], used[anchor[used] < 0]
        factors = [int(x) for x in (*anchor[ahead], *anchor[behind])]
        seen = np.zeros(len(self.ids), bool)
        done, step, n = 0, FIRST_ROUND, len(rows)
        while done < n:
            depth = min(n, done + step)
            fresh = np.zeros(len(self.ids), bool)
            if not len(used):  # every score is 0
                depth = n
                fresh[rows] = True
            fresh[lists[ahead, done:depth].ravel()] = True
            fresh[lists[behind, n - depth:n - done].ravel()] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            shown = (*values[ahead, depth - 1].tolist(), *values[behind, n - depth].tolist())
            bound = sum(f * v for f, v in zip(factors, shown))
            if met(new, self.scores(new, anchor), bound):
                return
            done, step = depth, 2 * step


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties by id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_of_label(vectors: Vectors, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best other vectors of a label."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def met(new, found, bound):
        nonlocal ids, scores
        other = vectors.ids[new] != anchor_id
        ids, scores = np.append(ids, vectors.ids[new][other]), np.append(scores, found[other])
        best = _first(scores, ids, k)
        ids, scores = ids[best], scores[best]
        return len(ids) == k and bound < scores[-1]

    vectors.search(anchor, label, met)
    return ids, scores


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int] | None]:
    """For each positive's score its window of whole scores, none for scores below 0."""
    return [(-(-low * s // 100), high * s // 100) if s >= 0 else None for s in scores]


def best_in_windows(
    vectors: Vectors, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, ids and scores of its ``k`` best vectors of other labels."""
    none = np.zeros(0, np.int64)
    kept = [(none, none) for _ in windows]

    def met(new, found, bound):
        other = (vectors.labels[new] != label) & (vectors.ids[new] != anchor_id)
        ids, scores, enough = vectors.ids[new][other], found[other], True
        for i, (low, high) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            held, held_scores = kept[i]
            if inside.any():
                held, held_scores = np.append(held, ids[inside]), np.append(held_scores, scores[inside])
                best = _first(held_scores, held, k)
                kept[i] = held, held_scores = held[best], held_scores[best]
            enough &= bound < (int(held_scores[-1]) if len(held) == k else low)
        return enough

    vectors.search(anchor, None, met)
    return kept


def _rows_of(batches, columns: list[str]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).select(columns).to_pylist()[0]


def _anchors(every: int):
    def anchors(batches):
        for row in _rows_of(batches, ["count", "ids", "labels", "width", "vectors"]):
            block = Vectors.of(row)
            chosen = np.flatnonzero(block.ids % every == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids[chosen]), pa.array(block.labels[chosen]),
                    pa.array(block.vectors[chosen].tolist(), pa.list_(pa.int64())),
                ],
                names=["id", "label", "vector"],
            )

    return anchors


def _met(batches):
    """Each anchor of each chunk with the vectors of each block; a block's lists serve all its chunks in a row."""
    last, vectors = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch["block"][i].as_py()
            if block != last:
                last, vectors = block, Vectors.of(next(_rows_of([batch.slice(i, 1)], ["count", "ids", "labels", "width", "vectors"])))
            for anchor in batch["anchors"][i].as_py():
                vector = np.zeros(vectors.vectors.shape[1], np.int64)
                given = np.array(anchor["vector"][: len(vector)], np.int64)
                vector[: len(given)] = given
                yield vectors, anchor, vector


def _batched(rows, schema: str, size: int = 10_000):
    """Record batches of rows of longs."""
    names = [field.split()[0] for field in schema.split(", ")]
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


def _best(k: int):
    def rows(batches):
        for vectors, anchor, vector in _met(batches):
            ids, scores = best_of_label(vectors, anchor["id"], anchor["label"], vector, k)
            yield from zip([anchor["id"]] * len(ids), ids.tolist(), scores.tolist())

    return lambda batches: _batched(rows(batches), BEST)


def _negatives(k: int, low: int, high: int):
    def rows(batches):
        for vectors, anchor, vector in _met(batches):
            windows = windows_of([p["score"] for p in anchor["positives"]], low, high)
            positives = [p for p, w in zip(anchor["positives"], windows) if w]
            kept = best_in_windows(vectors, anchor["id"], anchor["label"], vector, [w for w in windows if w], k)
            for positive, (ids, scores) in zip(positives, kept):
                for negative, score in zip(ids.tolist(), scores.tolist()):
                    yield anchor["id"], positive["id"], negative, positive["score"], score

    return lambda batches: _batched(rows(batches), MET)


def _chunked(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in anchors.columns if c != "chunk"))).alias("anchors"))


def _met_blocks(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every chunk of the stated anchors with every block; the anchors of a slice are bounded, so they are sent."""
    slot = lambda column: F.pmod(F.col(column), F.lit(1)).alias("slot")
    chunks = _chunked(anchors)
    return blocks.select("*", slot("block")).join(F.broadcast(chunks.select("anchors", slot("chunk"))), "slot").drop("slot")


def _ranked(rows: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _mined(blocks: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    best = mapped(_met_blocks(blocks, anchors), _best(positives), BEST)
    best = _ranked(best, ["anchor_id"], "score", "id", positives)
    each = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    ready = cut_lineage(anchors.join(each, "id"))
    met = mapped(_met_blocks(blocks, ready), _negatives(negatives, low, high), MET)
    ranked = _ranked(met, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame, vector: str = "embedding", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """Ranked negatives of each positive of each row whose ``vec_id`` is divisible by ``every``."""
    spark = rows.sparkSession
    whole = whole_vectors(rows, vector).select(F.spark_partition_id().cast("bigint").alias("part"), "id", "label", "vector")
    blocks = cut_lineage(mapped(whole, _blocked, BLOCKS))
    anchors = cut_lineage(mapped(blocks, _anchors(every), ANCHORS))
    # A search costs far more than its block's bytes say: each block is a task.
    blocks = blocks.repartition(max(1, blocks.count()))
    values = anchors.agg(F.sum(F.size("vector") + 2)).head()[0] or 0
    chunks = max(1, -(-values // CHUNK_VALUES))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    asked = (positives, negatives, low, high)
    if chunks <= SLICE_CHUNKS:
        return _mined(blocks, anchors, *asked)
    path, parts = scratch_path(spark, "negatives"), []
    for begin in range(0, chunks, SLICE_CHUNKS):
        parts.append(f"{path}/{begin}")
        inside = F.col("chunk").between(begin, begin + SLICE_CHUNKS - 1)
        _mined(blocks, anchors.filter(inside), *asked).write.parquet(parts[-1])
    return spark.read.schema(RESULT).parquet(*parts)

"""Concatenate and cut: all documents in one stream of ids, cut into equal sequences.

First pass: every partition encodes its documents and notes where each begins in the
partition's own stream. A running sum over the partitions' totals gives each partition its
place in the whole stream. Second pass: each document is cut where the
stream's windows end; a document that meets a window's border leaves a piece on either
side of it, so sequences join pieces of neighbouring partitions without moving any ids.

Defined cases: a null or empty text is its end id alone; repeated documents are packed
each for itself; only the last sequence is padded, and not where its length is a power
of two; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import attach_small, blocks, mapped
from gleanery.llm.token_ids import END, TokenIds
from gleanery.session import cut_lineage

SEQUENCE = 4096
STREAM = "part int, doc_id long, place long, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def _streamed(tokenizer_path: str, end: int):
    def encode(batches):
        tokens, at = TokenIds.shared(tokenizer_path, end), 0
        for block in blocks(batches):
            ids, counts = tokens.encode(block["text"])
            ends = np.concatenate([[0], np.cumsum(counts)])
            width = ids.itemsize
            held = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [block["part"], block["doc_id"], pa.array(at + ends[:-1]), pa.array(counts), held],
                names=["part", "doc_id", "place", "n", "ids"],
            )
            at += int(ends[-1])

    return encode


def id_stream(documents: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """First pass, written to the shared folder: ids of each document and its place in its partition."""
    rows = documents.select(
        F.spark_partition_id().alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    return cut_lineage(mapped(rows, _streamed(tokenizer_path, end), STREAM))


def partition_starts(stream: DataFrame, size: str = "n") -> DataFrame:
    """``part, before``: what all earlier partitions hold; one row for each partition."""
    totals = stream.groupBy("part").agg(F.sum(size).alias("_size"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("before"))


def _cut(length: int):
    def pieces(batches):
        for batch in batches:
            begin = batch["place"].to_numpy() + batch["before"].to_numpy()
            count = batch["n"].to_numpy()
            first, last = begin // length, (begin + count - 1) // length
            number = last - first + 1
            row = np.repeat(np.arange(len(count)), number)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + first[row]
            left = np.maximum(sequence * length, begin[row])
            size = np.minimum((sequence + 1) * length, begin[row] + count[row]) - left
            start = left - begin[row]
            crcs, held = [], []
            for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                raw = batch["ids"][r].as_buffer()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * count[r] else "<u4")[s:s + n].astype("<u4")
                held.append(ids.tobytes())
                crcs.append(zlib.crc32(held[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()),
                    pa.array(count[row]), pa.array(sequence), pa.array(left - sequence * length),
                    pa.array(held, pa.binary()),
                ],
                names=[part.split()[0] for part in PIECES.split(", ")],
            )

    return pieces


def pack(documents: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """The pieces of all sequences, each with its ids (little-endian unsigned 32-bit)."""
    stream = id_stream(documents, tokenizer_path, end)
    placed = attach_small(stream, cut_lineage(partition_starts(stream)), ["part"])
    return mapped(placed.select("doc_id", "place", "before", "n", "ids"), _cut(length), PIECES)


def padded_sizes(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``sequence_id, tokens, padded``: each sequence's ids, and its size with padding."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.pow(F.lit(2), F.floor(F.log2("tokens"))) == F.col("tokens")
    return sizes.withColumn("padded", F.when(power, F.col("tokens")).otherwise(F.lit(length)).cast("bigint"))

"""What the text operators share: bounded blocks of texts, words, hashes, sizes.

A word is a run of characters other than space and U+0009 to U+000D. Python
workers see texts in Arrow batches; ``blocks`` regroups them so that vector work
runs over a bounded number of bytes, whatever the partition holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Rows up to which a table counts as small enough to be sent to every executor.
SMALL_ROWS = 1_000_000


def document_key(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small batches up to about ``limit`` bytes each, and cut larger ones between rows."""
    held, size = [], 0
    for batch in (piece for whole in batches for piece in _pieces(whole, limit)):
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def in_pieces(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """A column function over a bounded number of bytes at a time."""
    rows = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    found = [work(*piece.columns) for piece in _pieces(rows, BLOCK_BYTES)]
    return pa.concat_arrays(found) if found else work(*columns)


def give_back() -> None:
    """Return freed memory to the machine: Python workers stay, and wait, beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def mapped(rows: DataFrame, worker: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` with a worker that leaves no memory behind."""

    def run(batches):
        yield from worker(batches)
        give_back()

    return rows.mapInArrow(run, schema)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and each text's number of words. Null texts have none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(words), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():
        words, owner = words.filter(full), owner[kept]
    return words, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's borders in them."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    borders = borders.astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a published finaliser of multiplicative hashes)."""
    with np.errstate(over="ignore"):
        values = values.astype(np.uint64)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(33))


_RANDOM = np.random.default_rng(20240131)
_BYTE_KEY = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _place_keys(n: int) -> np.ndarray:
    """A random-looking odd factor for each of the first ``n`` places in a word."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, equal on every machine; of the bytes alone."""
    data, borders = text_bytes(words)
    length = np.diff(borders)
    if not len(length):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(borders[:-1], length)
    with np.errstate(over="ignore"):
        terms = _BYTE_KEY[data] * _place_keys(int(length.max(initial=0)))[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mixed(sums[borders[1:]] - sums[borders[:-1]] + length.astype(np.uint64) * _STEP)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values: ``len - width + 1`` of them.

    Built by doubling, so that a run of 35 words costs seven passes and not 35.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, part, size, left = None, 0, mixed(values), 1, width
        while left:
            if left & 1:
                piece = part[done:done + count]
                out = piece if out is None else mixed(out * _STEP + piece)
                done += size
            left >>= 1
            if left:
                part = mixed(part[:-size] * _STEP + (part[size:] ^ np.uint64(size)))
                size *= 2
        return mixed(out + np.uint64(width))


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths laid end to end: each element's row and its place in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - first[owner]


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(table: DataFrame, size: Column | None = None) -> bool:
    """Whether a table has at most ``SMALL_ROWS`` rows and, by ``size``, as many values in them."""
    values = F.lit(1) if size is None else F.lit(1) + size
    return (table.limit(SMALL_ROWS + 1).agg(F.sum(values)).head()[0] or 0) <= SMALL_ROWS


def attach_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", size: Column | None = None) -> DataFrame:
    """Join a table that is usually small: sent to every executor if it is, else shuffled."""
    return rows.join(F.broadcast(small) if is_small(small, size) else small, on, how)

"""Sparse suffix arrays: passages of ``PASSAGE`` words or more that several documents share.

Of every ``WINDOW`` neighbouring positions, the suffix that begins with the least hash of
``GRAM`` words is retained. Copies of a passage retain the same suffixes, and one of
them begins within the passage's first ``WINDOW`` words, so at least ``HEAD`` words of the
passage follow it. Retained suffixes are sorted by their first ``HEAD`` words (as one number) and their
document; each is compared with its neighbours of other documents, with the first of its group, and
with the neighbours it has when its group is sorted by the words around the heads. Equal heads are extended left and right, word by word, by up to ``WINDOW``
words. A match of ``PASSAGE`` words is a repeat; the matches at all retained suffixes of a longer passage cover it.

Suffixes are sorted twice. Inside a block of texts all of them are; only the first and the
last document of each group go on to be sorted with those of other blocks, so a passage that a third of
all documents hold sends two documents a block and not each of its copies. In the second pass a
task holds the suffixes of one document at a time.

Words are lower-cased (A-Z). Heads are 64-bit hashes and extensions compare 16 bits of each
word's hash: an extension goes one word too far in 65,536.

Defined cases: null and empty texts, and texts shorter than ``PASSAGE``, repeat nothing; repeats
inside one document do not count; rows with equal doc_id and text are one document; of equal passages the one
in the smallest doc_id comes first (null before all); empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach_small, blocks, free_name, hash_words, mapped, rolling, signed, spans, split_words
from gleanery.llm.text_stats import word_codes
from gleanery.session import cut_lineage

PASSAGE = 50
GRAM = 4
WINDOW = 12
HEAD = PASSAGE - WINDOW + 1

#: ``begin`` is a suffix's position where ``sides`` is not null, else a found repeat's first word.
FOUND = "head long, document long, doc_id long, begin int, end int, later boolean, sides binary"
REPEATS = "document long, doc_id long, begin int, end int, later boolean"
UNITED = (
    "struct<repeats array<struct<begin int, end int>>, later array<struct<begin int, end int>>, "
    "n_repeated long, n_later long>"
)


def _least(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) of each run of ``width`` values."""
    out, size = values, 1
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions, over all texts end to end, of retained suffixes that at least ``HEAD`` words follow."""
    owner, place = spans(counts)
    grams = rolling(hashes, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = _least(grams, WINDOW, np.minimum)
    inside = place[:n] + WINDOW + GRAM - 1 <= counts[owner[:n]]
    least = np.where(inside, least, 0)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    chosen = _least(padded, WINDOW, np.maximum) == grams
    return np.flatnonzero(chosen & (place[:len(grams)] + HEAD <= counts[owner[:len(grams)]]))


def _sides(hashes: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the ``WINDOW`` words before each position (nearest first) and behind its head; 0 beyond the text."""
    owner, place = spans(counts)
    short = (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    out = np.zeros((len(at), 2 * WINDOW), np.uint16)
    here, size = place[at], counts[owner[at]]
    for k in range(WINDOW):
        left, right = here > k, here + HEAD + k < size
        out[left, k] = short[at[left] - 1 - k]
        out[right, WINDOW + k] = short[at[right] + HEAD + k]
    return out


def _extended(sides: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and behind the heads of suffixes ``one`` and ``two``."""
    same = (sides[one] == sides[two]) & (sides[one] != 0)
    run = [np.cumprod(same[:, half], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64) for half in (slice(0, WINDOW), slice(WINDOW, None))]
    return run[0], run[1]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Begins of runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _alike(head: np.ndarray, document: np.ndarray, sides: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours when suffixes of one head are sorted by the words before them and then by those behind."""
    if not len(rows):
        return rows, rows
    keys = np.ascontiguousarray(sides[rows].astype(">u2")).view(f"S{4 * WINDOW}").ravel()
    order = rows[np.lexsort([keys, head[rows]])]
    one, two = order[:-1], order[1:]
    fits = (head[one] == head[two]) & (document[one] != document[two])
    return one[fits], two[fits]


def _compared(head: np.ndarray, document: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sorted suffixes: matches (suffix, words before, words behind, whether with an earlier one), and
    whether each stands in the first and in the last document of its group."""
    n = len(head)
    group, run = _edges(head), _edges(head, document)
    group_of = np.searchsorted(group, np.arange(n), side="right") - 1
    run_of = np.searchsorted(run, np.arange(n), side="right") - 1
    group_begin, group_end = group[group_of], np.append(group[1:], n)[group_of]
    run_begin, run_end = run[run_of], np.append(run[1:], n)[run_of]
    first, last = run_begin == group_begin, run_end == group_end
    which, left, right, later = [], [], [], []
    one, two = _alike(head, document, sides, np.flatnonzero(~(first & last)))
    lone, few = np.flatnonzero(~first), np.flatnonzero(~last)
    for rows, partner in ((lone, run_begin[lone] - 1), (lone, group_begin[lone]), (few, run_end[few]), (one, two), (two, one)):
        before, behind = _extended(sides, rows, partner)
        enough = before + HEAD + behind >= PASSAGE
        which.append(rows[enough])
        left.append(before[enough])
        right.append(behind[enough])
        later.append((partner < rows)[enough])
    return tuple(np.concatenate(x) for x in (which, left, right, later)) + (first, last)


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals within each owner."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort([begin, owner])
    owner, begin, end = owner[order], begin[order], end[order]
    # Owners are laid apart on one line, so that one running maximum serves all.
    shift = owner.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.concatenate([[True], (begin + shift)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], begin[first], reach[last] - shift[last]


def _local(batches):
    """Repeats inside each block, and the suffixes that other blocks may match."""
    for block in blocks(batches):
        words, counts = split_words(block["text"], lower=True)
        if not len(words):
            continue
        codes, dictionary = word_codes(words)
        hashes = hash_words(dictionary)[codes]
        documents, doc_ids = block["document"].to_numpy(), block["doc_id"]
        ids = doc_ids.fill_null(0).to_numpy()
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort([documents, ids, doc_ids.is_valid().to_numpy(zero_copy_only=False)])] = np.arange(len(counts))
        at = anchors(hashes, counts)
        owner, place = spans(counts)
        heads = rolling(hashes, HEAD)[at]
        order = np.lexsort([place[at], rank[owner[at]], heads])
        at, head, text = at[order], heads[order], owner[at[order]]
        sides = _sides(hashes, counts, at)
        which, left, right, later, first, last = _compared(head, documents[text], sides)
        rows = []
        for kind in (True, False):
            own = which[later] if kind else which
            l, r = (left[later], right[later]) if kind else (left, right)
            t, begin, end = merged(text[own], place[at[own]] - l, place[at[own]] + HEAD + r)
            rows.append((t, begin, end, np.full(len(t), kind)))
        t, begin, end, kinds = (np.concatenate(x) for x in zip(*rows, strict=True))
        # Found repeats travel with any key that spreads them.
        yield _batch(signed(documents[t]), documents[t], doc_ids.take(pa.array(t)), begin, end, kinds, None)
        open_ = np.flatnonzero(first | last)
        yield _batch(
            signed(head[open_]), documents[text[open_]], doc_ids.take(pa.array(text[open_])), place[at[open_]],
            np.zeros(len(open_)), np.zeros(len(open_), bool), sides[open_],
        )


def _batch(head, document, doc_id, begin, end, later, sides) -> pa.RecordBatch:
    if sides is None:
        packed = pa.nulls(len(head), pa.binary())
    else:
        borders = np.arange(len(sides) + 1, dtype=np.int32) * (4 * WINDOW)
        packed = pa.Array.from_buffers(
            pa.binary(), len(sides), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(sides, "<u2").tobytes())]
        )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(head), pa.array(document), doc_id, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
            pa.array(later), packed,
        ],
        names=[part.split()[0] for part in FOUND.split(", ")],
    )


def _unpacked(sides: pa.Array) -> np.ndarray:
    data = b"".join(sides.to_pylist())
    return np.frombuffer(data, "<u2").reshape(-1, 2 * WINDOW)


def _across(batches):
    """Repeats among the open suffixes, which come sorted; found ones pass through."""
    held: pa.Table | None = None
    context = 0

    def results(rows: pa.Table, skip: int, stop: int):
        head, document = rows["head"].to_numpy(), rows["document"].to_numpy()
        sides = _unpacked(rows["sides"].combine_chunks())
        which, left, right, later, _, _ = _compared(head, document, sides)
        chosen = (which >= skip) & (which < stop)
        which, left, right, later = which[chosen], left[chosen], right[chosen], later[chosen]
        place = rows["begin"].to_numpy()[which].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(document[which]), rows["doc_id"].combine_chunks().take(pa.array(which)),
                pa.array((place - left).astype(np.int32)), pa.array((place + HEAD + right).astype(np.int32)), pa.array(later),
            ],
            names=[part.split()[0] for part in REPEATS.split(", ")],
        )

    for batch in batches:
        found = batch["sides"].is_null()
        yield batch.filter(found).select(["document", "doc_id", "begin", "end", "later"])
        rows = pa.Table.from_batches([batch.filter(batch["sides"].is_valid())])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        head, document = rows["head"].to_numpy(), rows["document"].to_numpy()
        last = int(_edges(head, document)[-1])
        yield results(rows, context, last)
        # The last document waits for what follows it; its group's first row and the row before it stay as partners.
        group = int(_edges(head)[-1])
        partners = sorted({group, last - 1}) if last > group else []
        held = pa.concat_tables([rows.slice(i, 1) for i in partners] + [rows.slice(last)])
        context = len(partners)
    if held is not None:
        yield results(held, context, held.num_rows)


def document_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's own number: equal for rows with equal doc_id and text."""
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text))


def found_repeats(documents: DataFrame) -> DataFrame:
    """``REPEATS``: shared passages by word positions, with overlaps; ``later`` where an earlier document has them."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", document_of().alias("document"))
    local = mapped(texts, _local, FOUND)
    ordered = local.repartition("head").sortWithinPartitions("head", "doc_id", "document", "begin")
    return mapped(ordered, _across, REPEATS)


def _united(found: pa.Array) -> pa.Array:
    owner = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    rows = found.flatten()
    begin, end, later = (rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("begin", "end", "later"))
    columns = []
    for chosen in (np.ones(len(owner), bool), later.astype(bool)):
        o, b, e = merged(owner[chosen], begin[chosen], end[chosen])
        borders = pa.array(np.searchsorted(o, np.arange(len(found) + 1)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], names=["begin", "end"])
        columns.append((pa.ListArray.from_arrays(borders, pairs), pa.array(np.bincount(o, e - b, len(found)).astype(np.int64))))
    return pa.StructArray.from_arrays(
        [columns[0][0], columns[1][0], columns[0][1], columns[1][1]], names=["repeats", "later", "n_repeated", "n_later"]
    )


def repeats(documents: DataFrame) -> DataFrame:
    """``document, doc_id, repeats, later, n_repeated, n_later`` of each document with a shared passage.

    The lists hold word positions (end exclusive) and are bounded by the document's length.
    """
    found = found_repeats(documents).groupBy("document", "doc_id").agg(
        F.collect_set(F.struct("begin", "end", "later")).alias("_found")
    )
    united = F.arrow_udf(_united, UNITED)
    return found.select("document", "doc_id", united("_found").alias("_u")).select("document", "doc_id", "_u.*")


def _cut(texts: pa.Array, later: pa.Array) -> pa.Array:
    out = texts.to_pylist()
    for i, cuts in enumerate(later.to_pylist()):
        if not cuts or out[i] is None:
            continue
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", out[i])] + [len(out[i])]
        kept, at = [], 0
        for cut in cuts:
            kept.append(out[i][at:starts[cut["begin"]]])
            at = starts[cut["end"]]
        out[i] = "".join([*kept, out[i][at:]])
    return pa.array(out, pa.string())


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents without the passages that an earlier one holds; one that has nothing else goes.

    All columns stay; ``n_chars`` follows the text where there is such a column.
    """
    mark, later = free_name(documents, "_document"), free_name(documents, "_later")
    cuts = repeats(documents).filter(F.size("later") > 0).select(F.col("document").alias(mark), F.col("later").alias(later))
    met = attach_small(documents.withColumn(mark, document_of()), cut_lineage(cuts), [mark], "left", F.size(later))
    cut = F.col(later).isNotNull()
    met = met.withColumn("text", F.when(cut, F.arrow_udf(_cut, "string")("text", later)).otherwise(F.col("text")))
    met = met.filter(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in documents.columns:
        size = F.length("text").cast(documents.schema["n_chars"].dataType)
        met = met.withColumn("n_chars", F.when(cut, size).otherwise(F.col("n_chars")))
    return met.select(*documents.columns)

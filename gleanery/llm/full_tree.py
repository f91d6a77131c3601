"""Context-tree weighting with every context of the training texts, as distributed rows.

The texts, decisions, estimates and weights are those of ``ctw``, with a node for each context of up to ``depth``
bytes (at most 6) that occurs. A gram is a context, its latest byte on top, with the byte that follows it lowest: all grams
that share a context's latest bytes are neighbours, so the tree needs no links.

Every gram of all texts is one row with its number of places in the training texts, which may be 0: nodes
without counts change nothing and tell what the shorter contexts say about such a gram. Rows are dealt by ranges of contexts, some ``PART`` in
each. A part holds most nodes whole; only the contexts that a range begins with, and what lies above them,
are shared by parts: at most ``depth`` for each part. A first pass gathers what each part knows of those, the driver
weighs them, a second pass carries their mixtures down and gives each gram its log2 probability.

The ``KNOWN`` most frequent grams go with the tasks that score; all others meet their probabilities in a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, give_back, mapped, split_words
from gleanery.llm.ctw import BLOCK, log_kt, normal_texts, stream
from gleanery.llm.text_stats import per_text
from gleanery.session import cut_lineage

#: Grams whose part of the tree is worked on at once.
PART = 1 << 17
#: Grams known to every executor, at most.
KNOWN = 1 << 21
#: Places and grams held at once, and grams from which on they are sent.
PLACES, HELD = 1 << 22, 3 << 20
#: Places that a number holds beside its gram, and numbers put together or sent at once.
MOST, PIECE_ROWS = 255, 1 << 17
#: An odd factor below 2 ** 56: grams times it are as many numbers, spread evenly; bits of the number of places looked up at once.
SPREAD, PIECE = np.uint64(0x9E3779B97F4A7C15 >> 8 | 1), 19


def grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each place of all texts, and each text's number of places."""
    data, counted, size = stream(texts, depth)
    # Read as little-endian numbers, the latest byte of a context is on top and the byte that follows above it.
    read = np.ndarray(len(counted), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))[counted]
    whole = np.uint64((1 << (8 * depth + 8)) - 1)
    read &= whole
    following = read >> np.uint64(8 * depth)
    read <<= np.uint64(8)
    read |= following
    read &= whole
    return read, size


def _first(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _put_together(held: np.ndarray) -> int:
    """Sorts numbers and puts those of a gram together, as far as a number holds their places; how many are left, in front."""
    held.sort()
    size = 0
    for i in range(0, len(held), PIECE_ROWS):
        gram, n = _counted(held[i:i + PIECE_ROWS])
        numbers = np.maximum(1, -(-n // MOST))
        last = np.cumsum(numbers)
        places = np.full(last[-1], MOST, np.uint64)
        places[last - 1] = n - MOST * (numbers - 1)
        held[size:size + len(places)] = (np.repeat(gram, numbers) << np.uint64(8)) | places
        size += len(places)
    return size


def _counted(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of some sorted numbers, each once, and their places."""
    gram = held >> np.uint64(8)
    first = _first(gram)
    return gram[first], np.add.reduceat((held & np.uint64(MOST)).view(np.int64), first)


def _rows(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted numbers as rows, in batches that take little beside other tasks'."""
    for i in range(0, len(held), PIECE_ROWS):
        gram, n = _counted(held[i:i + PIECE_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _met(depth: int):
    """Grams of all texts, with their places in training texts; one may come several times.

    They are held in one array as numbers, a gram and below it up to ``MOST`` of its places. It is sorted and put together
    in itself whenever it is full, so that a task takes the same memory however many texts it gets.
    """

    def count(batches):
        held, size = np.empty(PLACES, np.uint64), 0
        for block in blocks(batches, BLOCK):
            words, counts = split_words(block["text"], lower=True)
            numbers, sizes = grams(normal_texts(words, counts), depth)
            numbers <<= np.uint64(8)
            numbers |= np.repeat(~block["held_out"].fill_null(True).to_numpy(zero_copy_only=False), sizes)
            while len(numbers):
                piece, numbers = numbers[:PLACES - size], numbers[PLACES - size:]
                held[size:size + len(piece)] = piece
                size += len(piece)
                if size == PLACES:
                    size = _put_together(held)
                    if size >= min(HELD, PLACES // 4 * 3):
                        yield from _rows(held[:size])
                        size = 0
        size = _put_together(held[:size])
        yield from _rows(held[:size])

    return count


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the weighted probability of a node with children, and the weight of its own estimate."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def _shared(starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth but the last the contexts that parts may share: those above the contexts that parts start with."""
    return [np.unique(starts >> np.int64(8 * (depth - k))) for k in range(depth)]


@dataclass(frozen=True)
class Level:
    """Nodes of one depth for one bit of the byte that follows, by the bits before it and the context.

    Counts and ``below``, the logarithm of the product of what children say, leave out shared children.
    """

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray
    below: np.ndarray
    parent: np.ndarray
    shared: np.ndarray


class Plane:
    """The decisions on one bit of the byte that follows, in all nodes that a part's grams reach."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, bit: int, depth: int, shared: list[np.ndarray]) -> None:
        following = gram & 255
        key = (following >> (8 - bit)) << (8 * depth) | gram >> 8
        self.order = np.argsort(key, kind="stable")
        key, n = key[self.order], n[self.order]
        self.one = ((following >> (7 - bit)) & 1)[self.order] == 1
        first = _first(key)
        self.entry = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
        zeros, ones = np.add.reduceat(np.where(self.one, 0, n), first), np.add.reduceat(np.where(self.one, n, 0), first)
        self.estimate = (ones + 0.5) / (zeros + ones + 1.0)
        keys, mixed = key[first], log_kt(zeros, ones)
        levels = []
        for k in range(depth - 1, -1, -1):
            keys = keys >> 8
            first = _first(keys)
            parent = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
            keys = keys[first]
            zeros, ones, below = (np.add.reduceat(part, first) for part in (zeros, ones, mixed))
            mixed, weight = _mixed(zeros, ones, below)
            common = np.isin(keys & ((1 << 8 * k) - 1), shared[k])
            levels.append(Level(keys, zeros, ones, weight, below, parent, common))
            mixed, zeros, ones = (np.where(common, 0.0, part) for part in (mixed, zeros, ones))
        self.levels = levels[::-1]

    def log2(self, above: list[tuple]) -> np.ndarray:
        """log2 probability of the bit in each gram; ``above`` are keys, mixtures and what is left, of shared nodes."""
        given = left = None
        for level, (keys, shared_given, shared_left) in zip(self.levels, above):
            if given is None:
                given, left = np.zeros(len(level.keys)), np.ones(len(level.keys))
            else:
                given, left = given[parent], left[parent]
            given = given + left * level.weight * (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
            left = left * (1 - level.weight)
            at = np.searchsorted(keys, level.keys[level.shared])
            given[level.shared], left[level.shared] = shared_given[at], shared_left[at]
            parent = level.parent
        one = np.clip(given[parent] + left[parent] * self.estimate, 1e-15, 1 - 1e-15)[self.entry]
        return np.log2(np.where(self.one, one, 1 - one))


def _planes(rows: pa.Table, depth: int, shared: list[np.ndarray]) -> Iterator[tuple[int, Plane]]:
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    for bit in range(8):
        yield bit, Plane(gram, n, bit, depth, shared)


SHARED = "bit int, level int, key long, zeros double, ones double, below double"


def _gathered(depth: int, shared: list[np.ndarray]):
    """What a part knows of the nodes that parts share."""

    def gather(rows: pa.Table) -> pa.Table:
        out = []
        for bit, plane in _planes(rows, depth, shared):
            for k, level in enumerate(plane.levels):
                own = level.shared
                held = [level.keys[own], level.zeros[own], level.ones[own], level.below[own]]
                out.append(pa.table([np.full(own.sum(), bit, np.int32), np.full(own.sum(), k, np.int32), *held], names=[c.split()[0] for c in SHARED.split(", ")]))
        return pa.concat_tables(out)

    return gather


def _above(rows: pa.Table, depth: int) -> dict[int, list[tuple]]:
    """For each bit and depth the keys of the shared nodes, what they and those above give to a one, and what they leave."""
    columns = {c: rows[c].to_numpy() for c in rows.column_names}
    out = defaultdict(list)
    for bit in range(8):
        levels, keys_below = [], None
        for k in range(depth - 1, -1, -1):
            at = np.flatnonzero((columns["bit"] == bit) & (columns["level"] == k))
            at = at[np.argsort(columns["key"][at])]
            keys, zeros, ones, below = (columns[c][at] for c in ("key", "zeros", "ones", "below"))
            parent = None
            if keys_below is not None:
                parent = np.searchsorted(keys, keys_below >> 8)
                for whole, part in ((zeros, zeros_below), (ones, ones_below), (below, mixed)):
                    np.add.at(whole, parent, part)
            mixed, weight = _mixed(zeros, ones, below)
            levels.append((keys, weight, (ones + 0.5) / (zeros + ones + 1.0), parent))
            keys_below, zeros_below, ones_below = keys, zeros, ones
        given = left = parent = None
        for keys, weight, estimate, children in reversed(levels):
            given, left = (np.zeros(len(keys)), np.ones(len(keys))) if parent is None else (given[parent], left[parent])
            given, left = given + left * weight * estimate, left * (1 - weight)
            out[bit].append((keys, given, left))
            parent = children
    return out


def _predicted(depth: int, shared: list[np.ndarray], above: dict[int, list[tuple]]):
    """Every gram of a part with its log2 probability."""

    def predict(rows: pa.Table) -> pa.Table:
        total = np.zeros(rows.num_rows)
        for bit, plane in _planes(rows, depth, shared):
            total[plane.order] += plane.log2(above[bit])
        give_back()
        return pa.table({"gram": rows["gram"], "n": rows["n"], "log2": pa.array(total.astype(np.float32))})

    return predict


def predictions(texts: DataFrame, depth: int) -> DataFrame:
    """``gram, n, log2`` for every gram of ``texts`` (``text``, ``held_out``); what is not held out is learned from."""
    found = mapped(texts.select("text", "held_out"), _met(depth), "gram long, n long")
    # Tasks have put together what they met; another sum over it before the shuffle would take memory for few rows less.
    counted = cut_lineage(found.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n")))
    parts = max(1, -(-counted.count() // PART))
    dealt = counted.withColumn("context", F.shiftright("gram", 8)).repartitionByRange(parts, "context")
    dealt = cut_lineage(dealt.select(F.spark_partition_id().alias("part"), "gram", "n"))
    starts = dealt.groupBy("part").agg(F.min("gram").alias("gram")).toArrow()["gram"].to_numpy() >> 8
    shared = _shared(starts, depth)
    each = dealt.groupBy("part")
    sums = each.applyInArrow(_gathered(depth, shared), SHARED).groupBy("bit", "level", "key")
    above = _above(sums.agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow(), depth)
    return cut_lineage(each.applyInArrow(_predicted(depth, shared, above), "gram long, n long, log2 float"))


@dataclass(frozen=True)
class Known:
    """The most frequent grams, in the order of their spread numbers, and their log2 probabilities."""

    spread: np.ndarray
    log2: np.ndarray
    depth: int

    def score(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Each text's log2 probability in known grams, its bytes with the end, and texts, grams and times of the others."""
        gram, size = grams(normal_texts(words, counts), self.depth)
        value, far = np.zeros(len(gram)), np.zeros(len(gram), bool)
        for i in range(0, len(gram), 1 << PIECE):
            part = _spread(gram[i:i + (1 << PIECE)])
            # Numbers that begin alike become neighbours; those apart by chance are looked up more than once.
            keys = (part >> np.uint64(56 + PIECE - 64) << np.uint64(PIECE)) | np.arange(len(part), dtype=np.uint64)
            keys.sort()
            place = (keys & np.uint64((1 << PIECE) - 1)).astype(np.int64)
            part = part[place]
            first = _first(part)
            times = np.diff(first, append=len(part))
            at = np.minimum(np.searchsorted(self.spread, part[first]), max(0, len(self.spread) - 1))
            known = self.spread[at] == part[first] if len(self.spread) else np.zeros(len(first), bool)
            log2 = np.where(known, self.log2[at], 0.0) if len(self.spread) else np.zeros(len(first))
            value[i + place] = np.repeat(log2, times)
            far[i + place] = np.repeat(~known, times)
        return per_text(value, size), size, _others(gram, far, size)


def _others(gram: np.ndarray, far: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, grams and times of the places marked, in this order: 256 texts at once, as many as a number holds beside a gram."""
    ends, bits = np.concatenate([[0], np.cumsum(size)]), np.uint64(56)
    found = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for i in range(0, len(size), 256):
        own = slice(ends[i], ends[min(i + 256, len(size))])
        number = per_text(far[own].astype(np.int64), size[i:i + 256])
        keys = gram[own][far[own]]
        keys |= np.repeat(np.arange(len(number), dtype=np.uint64) << bits, number)
        keys.sort()
        first = _first(keys)
        key, times = keys[first], np.diff(first, append=len(keys)).astype(np.int32)
        found.append(((key >> bits).astype(np.int32) + np.int32(i), key & np.uint64((1 << 56) - 1), times))
    owner, gram, times = (np.concatenate(part) for part in zip(*found))
    return owner, gram, times


def _spread(gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (gram * SPREAD) & np.uint64((1 << 56) - 1)


def known(model: DataFrame, depth: int) -> Known:
    """The grams of the training texts that are met most often, ``KNOWN`` at most."""
    met = model.filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("grams")).toArrow()
    n, number = met["n"].to_numpy(), met["grams"].to_numpy()
    order = np.argsort(-n)
    fits = n[order][np.cumsum(number[order]) <= KNOWN]
    rows = model.filter(F.col("n") >= (int(fits[-1]) if len(fits) else 1 << 62)).select("gram", "log2").toArrow()
    spread = _spread(rows["gram"].to_numpy().view(np.uint64))
    order = np.argsort(spread)
    return Known(spread[order], rows["log2"].to_numpy()[order], depth)

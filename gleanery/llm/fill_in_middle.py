"""Fill-in-middle rearrangement, with cuts between tokens located by a wavelet matrix.

A token is a word with the white space before it; white space at a text's end is one more token.
Every byte of a block of texts gets a class: what kind of character part it is, and whether a
token ends with it. A wavelet matrix over the classes answers how often a class occurs before a
place. The ranks of the classes that end a token add up to the number of tokens before a place, those
of continuation bytes give its code points; each cut is found by bisection on the former,
for all texts of a block at once.

Where a text is cut and which form it takes are digits of a hash of ``seed`` and ``doc_id``, so a repeated
run, or a task run again, gives the same output.

Defined cases: a null text is the empty text; a missing ``doc_id`` hashes as the empty text; an empty text,
or one that spells one of the three marks, is left plain, so an output can always be taken apart;
equal rows give equal rows, each for itself; a text of white space alone is one token; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not looked at. A text
is held whole, with about eight bytes of working memory for each of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, mapped, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, how many are rearranged; and of a hundred of those, how many suffix first.
RATE, SUFFIX_FIRST = 50, 80
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

SPACE, LAST_SPACE, INSIDE, LAST, LEAD, CONTINUED, LAST_CONTINUED = range(7)
CLASS_BITS = 3
TOKEN_ENDS = (LAST_SPACE, LAST, LAST_CONTINUED)
NO_CHARACTER = (CONTINUED, LAST_CONTINUED)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, INSIDE, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    kinds[0x80:0xC0] = CONTINUED
    kinds[0xC0:] = LEAD
    return kinds


_KIND = _byte_kinds()


def byte_classes(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The class of each byte of texts laid end to end."""
    classes = _KIND[data]
    space = classes == SPACE
    ends = np.zeros(len(data), bool)
    ends[:-1] = space[1:]
    last = borders[1:][np.diff(borders) > 0] - 1
    ends[last] = True
    # White space ends a token only at the end of its text. A class that ends a token is one above its twin that does not.
    ends &= ~space
    ends[last] = True
    classes += ends
    return classes


class RankedBits:
    """A bit sequence that tells how many ones stand before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self._words = words
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.zeros = len(bits) - int(self._before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self._words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self._before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit sequence for each bit, high bits first.

    Each level is the sequence ordered, stably, by the bits above it; so a number's occurrences
    stay together from level to level, and two ranks a level follow them down.
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self._levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> np.uint8(bit) & np.uint8(1)).astype(bool)
            self._levels.append((bit, RankedBits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each of some places."""
        first, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bit, level in self._levels:
            if symbol >> bit & 1:
                first, at = level.zeros + level.ones(first), level.zeros + level.ones(at)
            else:
                first, at = first - level.ones(first), at - level.ones(at)
        return at - first

    def total(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


class Cutter:
    """Token counts, cuts and character counts of a block of texts."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.borders = text_bytes(texts)
        self._matrix = WaveletMatrix(byte_classes(self.data, self.borders), CLASS_BITS)
        ended = self._matrix.total(TOKEN_ENDS, self.borders)
        self._before, self.tokens = ended[:-1], np.diff(ended)

    def place(self, units: np.ndarray) -> np.ndarray:
        """The first place of each text with so many tokens before it."""
        low, high = self.borders[:-1].copy(), self.borders[1:].copy()
        wanted = self._before + units
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            enough = self._matrix.total(TOKEN_ENDS, middle) >= wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low

    def characters(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between places: bytes less those that continue a character."""
        return end - begin - self._matrix.total(NO_CHARACTER, end) + self._matrix.total(NO_CHARACTER, begin)


def draws(ids: pa.Array, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id: the first groups of SHA-256 of ``seed:id``."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids.to_pylist())
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _marked(texts: pa.Array) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    return found


def _rearranged(seed: int, rate: int, suffix_first: int):
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def outputs(batches):
        for block in blocks(batches):
            texts = pc.fill_null(block["text"], "")
            cutter, drawn = Cutter(texts), draws(block["doc_id"], seed)
            cuts = np.sort(drawn[:, :2] % (cutter.tokens + 1)[:, None], axis=1)
            first, second = cutter.place(cuts[:, 0]), cutter.place(cuts[:, 1])
            start, end = cutter.borders[:-1], cutter.borders[1:]
            plain = (start == end) | _marked(texts) | (drawn[:, 2] % 100 >= rate)
            by_suffix = drawn[:, 3] % 100 < suffix_first
            data, out = cutter.data.tobytes(), []
            for row in zip(start.tolist(), first.tolist(), second.tolist(), end.tolist(), plain.tolist(), by_suffix.tolist()):
                a, b, c, d, whole, spm = row
                if whole:
                    out.append(data[a:d])
                elif spm:
                    out.append(b"".join([s, data[c:d], p, data[a:b], m, data[b:c]]))
                else:
                    out.append(b"".join([p, data[a:b], s, data[c:d], m, data[b:c]]))
            form = np.where(plain, "plain", np.where(by_suffix, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [
                    block["doc_id"], pa.array(cutter.tokens), pa.array(form.tolist(), pa.string()),
                    pa.array(cutter.characters(start, first), mask=plain),
                    pa.array(cutter.characters(first, second), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return outputs


def rearrange(documents: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return mapped(rows, _rearranged(seed, rate, suffix_first), OUTPUT)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    size = F.length(output)
    middle = F.instr(output, MIDDLE)
    cut = F.when(form == "spm", F.instr(output, PREFIX)).otherwise(F.instr(output, SUFFIX))
    width = len(PREFIX)
    front = F.substring(output, F.lit(width + 1), cut - width - 1)
    back = F.substring(output, cut + width, middle - cut - width)
    between = F.substring(output, middle + width, size)
    return (
        F.when(form == "plain", output)
        .when(form == "spm", F.concat(back, between, front))
        .otherwise(F.concat(front, between, back))
    )

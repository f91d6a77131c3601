"""Re-Pair grammar compression of token ids, one grammar for each shard.

Documents are brought into ascending ``doc_id`` order, encoded, and cut into shards of
whole documents. In each shard the frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round, until no pair is frequent; a round replaces many
pairs at once, so its cost does not depend on their number. Pairs never cross a
document's end, so each document can be decoded alone.

A shard is one container (all numbers little-endian):

    magic "RPID", version u16, symbol width u16, documents i64, symbols i64, rules i64, first nonterminal i64
    doc_id i64 and null flag u8 of each document
    first id and first symbol of each document, and the totals, i64
    left and right symbol of each rule, symbol width
    number of ids each rule expands to, u32
    symbols, symbol width

Containers are stored as rows of a Parquet folder, beside their partition and their
place in it; the expansion lengths lead to any id of a document without expanding the
symbols before it.

Defined cases: null and empty texts are their end id alone; null doc_ids come first;
repeated doc_ids are ordered by their texts; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach_small, blocks, mapped
from gleanery.llm.packing import partition_starts
from gleanery.llm.token_ids import END, TokenIds, gathered

MAGIC, VERSION = b"RPID", 1
HEADER = "<4sHHqqqq"
#: Bytes of text encoded at once, some one and a half million ids.
BLOCK = 4 << 20
#: Ids in a shard, but for the rest of its last document.
SHARD_IDS = 1 << 20
#: Pairs met less often in a shard are left alone.
MIN_PAIR = 16
#: Pairs replaced in one round, and rules in one shard.
ROUND_RULES, MAX_RULES = 4096, 16_000
#: Rounds end when less than this share of the symbols goes away.
LEAST_GAIN = 0.02

SHARDS = "part int, place long, n long, container binary"
DOCUMENTS = "part int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary"


def grammar(symbols: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs; ``last`` marks each document's last symbol. Returns symbols, marks and rules."""
    wide = symbols.dtype.itemsize > 2
    code_type, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    factor = code_type(0x9E3779B97F4A7C15 if wide else 0x9E3779B1)
    to_table = code_type((64 if wide else 32) - 20)
    rules = np.zeros((0, 2), symbols.dtype)
    while len(rules) < MAX_RULES and len(symbols) > 1:
        codes = (symbols[:-1].astype(code_type) << code_type(shift)) | symbols[1:].astype(code_type)
        inner = ~last[:-1]
        ordered = np.sort(codes[inner])
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= MIN_PAIR)
        room = min(ROUND_RULES, MAX_RULES - len(rules))
        if len(often) > room:
            often = np.sort(often[np.argsort(-count[often], kind="stable")[:room]])
        if not len(often):
            break
        pairs = ordered[first[often]]
        table = np.zeros(1 << 20, bool)
        with np.errstate(over="ignore"):
            table[(pairs * factor) >> to_table] = True
            near = np.flatnonzero(table[(codes * factor) >> to_table] & inner)
        rule = np.minimum(np.searchsorted(pairs, codes[near]), len(pairs) - 1)
        met = pairs[rule] == codes[near]
        at, rule = near[met], rule[met]
        # Of pairs that overlap, every second one from the left.
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        number = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at, rule = at[number % 2 == 0], rule[number % 2 == 0]
        used, rule = np.unique(rule, return_inverse=True)
        symbols, last = symbols.copy(), last.copy()
        symbols[at] = (base + len(rules) + rule).astype(symbols.dtype)
        last[at] = last[at + 1]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        low = code_type((1 << shift) - 1)
        new = np.column_stack([pairs[used] >> code_type(shift), pairs[used] & low]).astype(symbols.dtype)
        rules = np.concatenate([rules, new])
        gain = len(at) / len(symbols)
        symbols, last = symbols[kept], last[kept]
        if gain < LEAST_GAIN:
            break
    return symbols, last, rules


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids that the rules stand for end to end, and how many each stands for."""
    pool = rules.ravel().astype(np.int64)
    owner = np.repeat(np.arange(len(rules)), 2)
    while len(pool) and (inner := pool >= base).any():
        width = np.where(inner, 2, 1)
        begin = (np.cumsum(width) - width)[inner]
        pair = rules[pool[inner] - base].astype(np.int64)
        pool, owner = np.repeat(pool, width), np.repeat(owner, width)
        pool[begin], pool[begin + 1] = pair[:, 0], pair[:, 1]
    return pool, np.bincount(owner, minlength=len(rules)).astype(np.int64)


def container(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """One shard as bytes."""
    kind = np.dtype("<u2" if vocabulary + MAX_RULES <= 1 << 16 else "<u4")
    ends = np.cumsum(counts)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, last, rules = grammar(ids.astype(kind), last, vocabulary)
    parts = [
        struct.pack(HEADER, MAGIC, VERSION, kind.itemsize, len(counts), len(symbols), len(rules), vocabulary),
        doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
        doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(),
        np.concatenate([[0], ends]).astype("<i8").tobytes(),
        np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<i8").tobytes(),
        rules.astype(kind).tobytes(),
        expansions(rules, vocabulary)[1].astype("<u4").tobytes(),
        symbols.astype(kind).tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """A container opened for reading."""

    def __init__(self, data: bytes) -> None:
        magic, version, width, documents, symbols, rules, self.base = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        self._data, self._at = data, struct.calcsize(HEADER)
        kind = f"<u{width}"
        ids, null = self._read("<i8", documents), self._read("u1", documents)
        self.doc_ids = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.first_id = self._read("<i8", documents + 1)
        self.first_symbol = self._read("<i8", documents + 1)
        self.rules = self._read(kind, 2 * rules).reshape(-1, 2)
        self.expands_to = self._read("<u4", rules).astype(np.int64)
        self.symbols = self._read(kind, symbols)

    def _read(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, count, self._at)
        self._at += out.nbytes
        return out

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        sizes[inner] = self.expands_to[symbols[inner] - self.base]
        return sizes

    def all_ids(self) -> np.ndarray:
        pool, lengths = expansions(self.rules, self.base)
        first = np.concatenate([np.arange(self.base), self.base + np.cumsum(lengths) - lengths])
        return gathered(np.concatenate([np.arange(self.base), pool]), first[self.symbols], self._sizes(self.symbols)).astype("<u4")

    def ids(self, document: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of one document; symbols outside them are not expanded."""
        symbols = self.symbols[self.first_symbol[document]:self.first_symbol[document + 1]].astype(np.int64)
        ends = np.cumsum(self._sizes(symbols))
        end = int(ends[-1]) if end is None else min(end, int(ends[-1]))
        if begin >= end:
            return np.zeros(0, "<u4")
        left, right = np.searchsorted(ends, [begin, end - 1], side="right")
        skipped = int(ends[left - 1]) if left else 0
        out = symbols[left:right + 1]
        while (inner := out >= self.base).any():
            width = np.where(inner, 2, 1)
            place = (np.cumsum(width) - width)[inner]
            pair = self.rules[out[inner] - self.base].astype(np.int64)
            out = np.repeat(out, width)
            out[place], out[place + 1] = pair[:, 0], pair[:, 1]
        return out[begin - skipped:end - skipped].astype("<u4")


def _sharded(tokenizer_path: str, end: int, shard_ids: int):
    def shards(batches):
        tokens, place = TokenIds.shared(tokenizer_path, end), 0
        for block in blocks(batches, BLOCK):
            ids, counts = tokens.encode(block["text"])
            ends = np.cumsum(counts)
            group = (ends - 1) // shard_ids
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = ids[ends[a] - counts[a]:ends[b - 1]]
                data = container(block["doc_id"][a:b], own, counts[a:b], tokens.vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [block["part"][:1], pa.array([place]), pa.array([len(own)]), pa.array([data], pa.binary())],
                    names=["part", "place", "n", "container"],
                )
                place += len(own)

    return shards


def write(documents: DataFrame, path: str, tokenizer_path: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents in ascending ``doc_id`` order into shards below ``path``."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    shards = mapped(placed, _sharded(tokenizer_path, end, shard_ids), SHARDS)
    shards.write.option("compression", "uncompressed").parquet(path)


def _opened(batches):
    for batch in batches:
        for part, place, data in zip(batch["part"], batch["place"], batch["container"], strict=True):
            shard = Shard(data.as_buffer().to_pybytes())
            raw, borders = shard.all_ids().tobytes(), (shard.first_id * 4).tolist()
            pieces = [raw[a:b] for a, b in zip(borders, borders[1:], strict=False)]
            count = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * count, pa.int32()), shard.doc_ids,
                    pa.array(place.as_py() + shard.first_id[:-1]), pa.array(np.diff(shard.first_id)),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary()),
                ],
                names=[part_.split()[0] for part_ in DOCUMENTS.split(", ")],
            )


def read(shards: DataFrame) -> DataFrame:
    """Every document of the written shards: its ids, and ``start``, the ids of all before it."""
    totals = partition_starts(shards.select("part", "n"))
    return attach_small(mapped(shards, _opened, DOCUMENTS), totals, ["part"]).select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )

"""Exact similarity join of documents by the Jaccard similarity of their five-word shingles.

Equal sets are one set from the start. Two sets link when ``100 * shared >= SIMILARITY * union``; a
document's class is everything its set reaches by links. Sets that are highly similar are
found first: sets with an equal least hash meet in cells of at most ``CELL`` sets, where all of their
links are computed, and a set whose link to a class is known takes over the answers of that class: no pair inside
a class is looked at again.

The links that remain are found by an index. Shingles are ordered by how often they occur, rare ones
first, and each set is listed under its first ones, as many as a link cannot do without. A list is
skipped as a whole if it holds one class, and in it the pairs whose positions cannot give
enough shared shingles are never formed. Of the pairs left, a parity sketch bounds the number
of shingles that differ from below; what passes is compared word for word in cells again. Every
filter is a bound, so no link is lost.

Defined cases: null and empty texts have the empty set and link with nothing; a text of fewer than five words
has one shingle, the whole; repeated documents share a set; null doc_ids count after all others
as the smallest of a class; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import attach_small, blocks, free_name, hash_words, mapped, mixed, rolling, signed, spans, split_words
from gleanery.llm.components import components
from gleanery.llm.suffixes import document_of
from gleanery.llm.text_stats import word_codes
from gleanery.session import cut_lineage

SHINGLE = 5
SIMILARITY = 80
#: Least hashes by which similar sets meet.
KEYS = 3
CELL = 512
#: Bits of the parity sketch.
SKETCH = 512
#: Shingles known to every executor as frequent, at most.
FREQUENT = 1 << 20
#: Shingles among which a task looks for those that several sets have.
HELD = 2_000_000
#: Texts in a block: a text's number and 48 bits of a shingle share one number.
TEXTS = 1 << 15
SETS = (
    "document long, doc_id long, n_shingles long, node long, keys array<long>, sketch array<long>, "
    "often array<long>, often_n array<int>"
)
LISTED = "token long, node long, size int, place int"


def _small_blocks(batches):
    for block in blocks(batches):
        for i in range(0, block.num_rows, TEXTS):
            yield block.slice(i, TEXTS)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as ``text number << 48 | 48 bits``, sorted, and their number per text."""
    words, counts = split_words(texts, lower=True)
    codes, dictionary = word_codes(words)
    hashes = hash_words(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    owner, place = spans(counts)
    runs = rolling(hashes, SHINGLE)
    whole = np.flatnonzero(place[:len(runs)] + SHINGLE <= counts[owner[:len(runs)]])
    values, of = runs[whole], owner[whole]
    ends = np.cumsum(counts)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        if len(short):
            values = np.concatenate([values, rolling(hashes, size)[ends[short] - size]])
            of = np.concatenate([of, short])
    keys = np.sort((of.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(counts)).astype(np.int64)


_LOW = np.uint64((1 << 48) - 1)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _node(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; 0 for the empty set."""
    low = keys & _LOW
    with np.errstate(over="ignore"):
        both = mixed(_sums(mixed(low), counts)) ^ _sums(mixed(low ^ np.uint64(0x5BD1E995)), counts)
        out = mixed(both + counts.astype(np.uint64)) | np.uint64(1)
    return np.where(counts > 0, out, 0).astype(np.uint64)


def _sets(batches):
    """One row for each text, and one row for some millions of shingles with those that several sets have."""
    held, seen, number = [], [], 0
    for block in _small_blocks(batches):
        keys, counts = shingles(block["text"])
        node, low, n = _node(keys, counts), keys & _LOW, len(counts)
        owner = (keys >> np.uint64(48)).astype(np.int64)
        filled = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[filled]
        least = np.zeros((n, KEYS), np.uint64)
        for k in range(KEYS if len(low) else 0):
            least[filled, k] = np.minimum.reduceat(mixed(low ^ np.uint64(0x9E37 * (k + 1))), first)
        cell = owner * SKETCH + (mixed(low) % np.uint64(SKETCH)).astype(np.int64)
        odd = (np.bincount(cell, minlength=n * SKETCH) & 1).astype(np.uint8)
        sketch = np.packbits(odd.reshape(n, SKETCH), axis=1).view(np.int64)
        yield _set_rows(block["document"], block["doc_id"], counts, node, least, sketch)
        once = np.zeros(n, bool)
        once[np.unique(node, return_index=True)[1]] = True
        if seen:
            once &= ~np.isin(node, np.concatenate(seen))
        held.append(low[once[owner]])
        seen.append(node[once])
        number += len(held[-1])
        if number >= HELD:
            yield _often_row(np.concatenate(held))
            held, seen, number = [], [], 0
    if held:
        yield _often_row(np.concatenate(held))


def _often_row(shared: np.ndarray) -> pa.RecordBatch:
    shared.sort()
    edge = np.flatnonzero(np.concatenate([[True], shared[1:] != shared[:-1]])) if len(shared) else np.zeros(0, np.int64)
    times = np.diff(edge, append=len(shared))
    often = times >= 2
    one, empty = pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64()))
    lists = (
        pa.array([signed(shared[edge[often]])], pa.list_(pa.int64())),
        pa.array([times[often].astype(np.int32)], pa.list_(pa.int32())),
    )
    return pa.RecordBatch.from_arrays([one, one, one, one, empty, empty, *lists], names=_names(SETS))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _set_rows(document, doc_id, counts, node, least, sketch) -> pa.RecordBatch:
    def listed(rows: np.ndarray) -> pa.Array:
        borders = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(borders), pa.array(rows.ravel()))

    return pa.RecordBatch.from_arrays(
        [
            document, doc_id, pa.array(counts), pa.array(signed(node)), listed(signed(least.ravel()).reshape(least.shape)),
            listed(sketch), pa.nulls(len(counts), pa.list_(pa.int64())), pa.nulls(len(counts), pa.list_(pa.int32())),
        ],
        names=_names(SETS),
    )


def needed(size: np.ndarray) -> np.ndarray:
    """Shingles that a set of this size shares with any set that it links with."""
    return -(-SIMILARITY * size // 100)


def _listed(frequent: np.ndarray, rank: np.ndarray):
    """The first shingles of each set, rare ones first, with their places."""

    def rows(batches):
        for block in _small_blocks(batches):
            keys, counts = shingles(block["text"])
            if not len(keys):
                continue
            node = _node(keys, counts)
            once = np.zeros(len(counts), bool)
            once[np.unique(node, return_index=True)[1]] = True
            owner = (keys >> np.uint64(48)).astype(np.int64)
            keys = keys[once[owner]]
            low, top = keys & _LOW, keys & ~_LOW
            value = low >> np.uint64(1)
            if len(frequent):
                marks = np.zeros(1 << 20, bool)
                marks[(frequent >> np.uint64(28)).astype(np.int64)] = True
                near = np.flatnonzero(marks[(low >> np.uint64(28)).astype(np.int64)])
                at = np.minimum(np.searchsorted(frequent, low[near]), len(frequent) - 1)
                hit = frequent[at] == low[near]
                value[near[hit]] = np.uint64(1 << 47) + rank[at[hit]]
            ordered = np.sort(top | value)
            owner = (ordered >> np.uint64(48)).astype(np.int64)
            size = np.bincount(owner, minlength=len(counts))
            place = np.arange(len(ordered)) - (np.cumsum(size) - size)[owner]
            first = place <= (size - needed(size))[owner]
            owner, place = owner[first], place[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(ordered[first] & _LOW)), pa.array(signed(node[owner])),
                    pa.array(size[owner].astype(np.int32)), pa.array(place.astype(np.int32)),
                ],
                names=_names(LISTED),
            )

    return rows


def _linked(keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links among the sets of one cell, as many as connect them."""
    low = keys & _LOW
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(low, kind="stable")
    low, owner = low[order], owner[order]
    new = np.concatenate([[True], low[1:] != low[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column = np.unique(column[often], return_inverse=True)[1]
    owner = owner[often]
    shared = np.zeros((len(counts), len(counts)), np.float32)
    for begin in range(0, int(column.max(initial=-1)) + 1, 4096):
        inside = (column >= begin) & (column < begin + 4096)
        part = np.zeros((len(counts), 4096), np.float32)
        part[owner[inside], column[inside] - begin] = 1
        shared += part @ part.T
    union = counts[:, None] + counts[None, :] - shared
    link = (100 * shared >= SIMILARITY * union) & (nodes[:, None] != nodes[None, :])
    label = np.arange(len(counts))
    one, two = np.nonzero(np.triu(link))
    if not len(one):
        return []
    while True:
        least = label.copy()
        np.minimum.at(least, one, label[two])
        np.minimum.at(least, two, label[one])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(counts)))
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True))


def _cells(batches):
    """Links in each cell; rows come sorted by cell and node."""
    held: pa.Table | None = None

    def solved(rows: pa.Table):
        cell, node = rows["cell"].to_numpy(), rows["node"].to_numpy()
        once = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])
        rows, cell, node = rows.filter(pa.array(once)), cell[once], node[once]
        out = []
        for part in range(0, len(cell), TEXTS):
            keys, counts = shingles(rows["text"].slice(part, TEXTS).combine_chunks())
            ends = np.cumsum(counts)
            own = cell[part:part + TEXTS]
            edge = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1:
                    out += _linked(keys[ends[a] - counts[a]:ends[b - 1]], counts[a:b], node[part + a:part + b])
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in blocks(batches):
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cell = rows["cell"].to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))
        if last:
            yield solved(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield solved(held)


def _in_cells(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Links among the ``members`` (document, node, cell) of each cell."""
    texts = attach_small(documents, members, ["document"])
    met = texts.select("cell", "node", "text").repartition("cell").sortWithinPartitions("cell", "node")
    return mapped(met, _cells, "a long, b long")


def _cell(key: Column, node: Column, size: Column) -> Column:
    """A cell of the key: one, or several that split its sets evenly where they are many."""
    parts = F.ceil(size / F.lit(CELL // 2)).cast("long")
    return F.xxhash64(key, F.when(size > CELL, F.pmod(F.xxhash64(node), parts)).otherwise(F.lit(0).cast("long")))


def _by_key(sets: DataFrame) -> DataFrame:
    """``document, node, cell`` of the sets that have a least hash in common with another."""
    keyed = sets.select("document", "node", F.posexplode("keys").alias("k", "key"))
    many = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = keyed.join(many, ["k", "key"])
    return met.select("document", "node", _cell(F.hash("k", "key"), F.col("node"), F.col("_n")).alias("cell")).distinct()


def _open_lists(listed: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists that hold several classes, each set with its sketch; all other lists are skipped."""
    token = W.partitionBy("token")
    bounds = listed.withColumn("_low", F.min("class").over(token)).withColumn("_high", F.max("class").over(token))
    left = bounds.filter("_low < _high").drop("_low", "_high").dropDuplicates(["token", "node"])
    return cut_lineage(left.join(sets.select("node", "document", "sketch"), "node"))


def _pairs(lists: DataFrame) -> DataFrame:
    """Pairs of sets of different classes that neither places nor sketches can rule out."""
    columns = ("node", "document", "class", "size", "place", "sketch")
    one = lists.select("token", *[F.col(c).alias(f"{c}_1") for c in columns])
    two = lists.select("token", *[F.col(c).alias(f"{c}_2") for c in columns])
    both = F.col("size_1") + F.col("size_2")
    reach = F.least(F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2"))
    apart = F.lit(0)
    for i in range(SKETCH // 64):
        apart = apart + F.bit_count(F.col("sketch_1")[i].bitwiseXOR(F.col("sketch_2")[i]))
    met = one.join(
        two,
        (one["token"] == two["token"])
        & (F.col("class_1") < F.col("class_2"))
        & ((100 + SIMILARITY) * reach >= SIMILARITY * both)
        # Each shingle that only one set has turns one bit, so at least ``apart`` shingles differ.
        & ((100 + SIMILARITY) * apart <= (100 - SIMILARITY) * both),
    )
    return met.select(
        F.col("node_1").alias("x"), F.col("document_1").alias("dx"), F.col("node_2").alias("y"), F.col("document_2").alias("dy")
    ).distinct()


def _frequent(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their ranks by frequency: at most ``FREQUENT``."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    least = None
    room = FREQUENT
    # The counts' logarithms have some hundred steps.
    for row in often.groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        room -= row["n"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = often.filter(step >= least).toArrow()
    tokens, count = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort([tokens, count])] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _by_pair(pairs: DataFrame) -> DataFrame:
    """``document, node, cell`` that bring the sets of each pair together: the pairs of one set, split where they are many."""
    size = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("_n"))
    cells = pairs.join(size, "x").withColumn("cell", _cell(F.col("x"), F.col("y"), F.col("_n") + 1))
    return cells.select(F.col("dy").alias("document"), F.col("y").alias("node"), "cell").unionByName(
        cells.select(F.col("dx").alias("document"), F.col("x").alias("node"), "cell")
    ).distinct()


def classes(documents: DataFrame) -> DataFrame:
    """``document, doc_id, n_shingles, component_id, class`` of every document; the class of an empty set is null."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", document_of().alias("document"))
    rows = cut_lineage(mapped(texts, _sets, SETS))
    found = rows.filter(F.col("node").isNotNull())
    sets = cut_lineage(
        found.filter("n_shingles > 0").groupBy("node").agg(
            F.min("document").alias("document"), F.min("doc_id").alias("first_id"),
            F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
        )
    )
    often = rows.filter(F.col("node").isNull()).select(F.explode(F.arrays_zip("often", "often_n")).alias("_o"))
    often = often.groupBy(F.col("_o.often").alias("token")).agg(F.sum("_o.often_n").cast("long").alias("n"))
    frequent = _frequent(cut_lineage(often))
    pairs_of_text = texts.select("document", "text")
    similar = cut_lineage(_in_cells(pairs_of_text, _by_key(sets)))
    known = components(similar).select("node", F.col("component").alias("class"))
    listed = mapped(texts.select("text"), _listed(*frequent), LISTED)
    listed = attach_small(listed, known, ["node"], "left").withColumn("class", F.coalesce("class", "node"))
    pairs = cut_lineage(_pairs(_open_lists(listed, sets)))
    rest = cut_lineage(_in_cells(pairs_of_text, _by_pair(pairs)))
    label = components(similar.unionByName(rest))
    labelled = sets.select("node", "first_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = labelled.join(smallest, "component").select("node", "component", "component_id")
    joined = found.select("document", "doc_id", "n_shingles", "node").join(by_node, "node", "left")
    return joined.select(
        "document", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("component").alias("class"),
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The first document of each class, with all its columns; documents with empty sets all stay.

    First is the smallest doc_id (null after all others), and of equal ones the smallest
    document number; of rows with equal doc_id and text one stays.
    """
    found = cut_lineage(classes(documents).filter("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("document").alias("d"))
    first = found.groupBy("class").agg(F.min(order)["d"].alias("document"))
    mark, one = free_name(documents, "_document"), free_name(documents, "_row")
    dropped = found.select("document").distinct().join(first, "document", "left_anti")
    marked = documents.withColumn(mark, document_of())
    kept = attach_small(marked, cut_lineage(dropped.withColumnRenamed("document", mark)), [mark], "left_anti")
    again = found.groupBy("document").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("document").alias(mark))
    if again.isEmpty():
        return kept.select(*documents.columns)
    row = F.struct(*[F.col(c) for c in documents.columns])
    once = kept.join(again, mark, "left_semi").groupBy(mark).agg(F.first(row).alias(one)).select(f"{one}.*")
    return kept.join(again, mark, "left_anti").select(*documents.columns).unionByName(once)

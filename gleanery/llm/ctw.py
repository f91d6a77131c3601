"""Context-tree weighting over bytes: the code length of each text under one trained tree.

A text is its lower-cased words (A-Z) with one space between them, as bytes, and an end.
Each byte is eight binary decisions; each decision has a tree of contexts, the last bytes
before it, up to ``DEPTH``. Every node holds a Krichevsky-Trofimov estimate from the counts
of the training texts, and the estimates of all depths are mixed by their context-tree weights:
half the node's own estimate, half the product of what its children say.

Three passes: the first finds the contexts worth a node, those that make up a share of the
corpus; the second counts what follows each node's context, over all training
texts; after it the weights are computed and every node knows its predictions; the third scores all texts.
The share falls as the corpus grows, without a floor, so the tree grows with it. Every context that reaches the share
gets a node, and others with half of it may: at most ``2 / share`` of a depth, which is the size of the tree that is
sent to the executors. Positions whose context has no node of its own are counted together, as one more child of
the deepest node that they reach. ``full_tree`` has a node for every context instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, give_back, mapped, signed, split_words, text_bytes
from gleanery.llm.text_stats import per_text
from gleanery.session import cut_lineage

DEPTH = 6
#: A context gets a node if it makes up 1 / (NODES * bytes ** 0.25) of the corpus.
NODES = 2000
#: Bytes of text worked on at once.
BLOCK = 2 << 20
#: Byte that ends a text and stands before its beginning; UTF-8 never holds it.
END = 0xFF


def normal_texts(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each text's words with one space between them."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")


def stream(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with ``depth`` ends before each, which places from ``depth`` on count, and texts' sizes."""
    data, borders = text_bytes(texts)
    size = np.diff(borders) + 1
    begin = np.cumsum(size + depth) - size
    out = np.full(int((size + depth).sum()), END, np.uint8)
    shift = np.repeat((begin - borders[:-1]).astype(np.int32), size - 1)
    shift += np.arange(len(data), dtype=np.int32)
    out[shift] = data
    edges = np.zeros(len(out) + 1, np.int8)
    edges[begin] = 1
    edges[(begin + size)[:-1]] -= 1
    return out, np.cumsum(edges[:-1], dtype=np.int8).view(bool)[depth:], size


def _contexts(share: float, depth: int):
    """Contexts with half the share in a block, latest byte first; its size (depth 0) and its bytes (depth -1)."""

    def find(batches):
        for block in blocks(batches, BLOCK):
            words, counts = split_words(block["text"], lower=True)
            data, counted, _ = stream(normal_texts(words, counts), depth)
            # Eight bytes read as one little-endian number have the latest byte on top.
            padded = np.concatenate([np.full(8 - depth, END, np.uint8), data])
            codes = np.ndarray(len(counted), "<u8", padded, strides=(1,))[counted]
            codes = np.sort(codes & np.uint64((1 << 64) - (1 << (8 * (8 - depth)))))
            if not len(codes):
                continue
            seen = np.flatnonzero(np.bincount(data, minlength=256)).astype(np.uint64)
            depths, found, number = [0, -1], [np.zeros(1, np.uint64), seen], [np.array([len(codes)]), np.ones(len(seen), np.int64)]
            value, count = codes, None
            for k in range(depth, 0, -1):
                value = value >> np.uint64(8 * (8 - k)) << np.uint64(8 * (8 - k))
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                count = np.diff(first, append=len(value)) if count is None else np.add.reduceat(count, first)
                value = value[first]
                often = 2 * count >= share * len(codes)
                depths.append(k)
                found.append(value[often])
                number.append(count[often])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(depths, [len(f) for f in found]).astype(np.int32)),
                    pa.array(signed(np.concatenate(found))), pa.array(np.concatenate(number)),
                ],
                names=["depth", "context", "n"],
            )

    return find


@dataclass(frozen=True)
class Tree:
    """``child[state, column]`` for the byte one step further back; the last row is a dead end.

    States with children come first and have a row each; all others share the last row.
    Bytes that stand for themselves in some context or text have a column each; all others share the last.
    """

    child: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    column: np.ndarray

    @property
    def states(self) -> int:
        return len(self.parent)

    @property
    def inner(self) -> int:
        return len(self.child) - 1

    @property
    def width(self) -> int:
        return self.child.shape[1]

    def cells(self, data: np.ndarray, depth: int) -> np.ndarray:
        """For each place from ``depth`` on: deepest node that the bytes before lead to, and the byte's column, as one number."""
        data = self.column[data]
        each = np.arange(self.width, dtype=np.int32)
        state, best = self._step(np.zeros(self.width, np.int32), np.zeros(self.width, np.int32), each)
        size = len(data) - depth

        def back(k: int) -> np.ndarray:
            return data[depth - k:depth - k + size]

        if depth > 1:
            # The two latest bytes lead to a node at once.
            state, best = self._step(np.repeat(state, self.width), np.repeat(best, self.width), np.tile(each, self.width))
            place = back(1).astype(np.int32) * self.width + back(2)
        else:
            place = back(1)
        state, best = state[place], best[place]
        for k in range(3, depth + 1):
            state, best = self._step(state, best, back(k))
        return best * np.int32(self.width) + back(0)

    def _step(self, state: np.ndarray, best: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = self.child.ravel()[np.minimum(state, np.int32(self.inner)) * np.int32(self.width) + column]
        return state, np.where(state != self.states, state, best)


def grow(depths: np.ndarray, contexts: np.ndarray, depth: int, seen: np.ndarray) -> Tree:
    """A tree of these contexts; one without all its shorter contexts is left out. ``seen`` are the bytes met."""
    column = np.full(256, len(seen), np.uint8)
    column[seen] = np.arange(len(seen))
    parents, levels, place = [np.array([-1])], [np.array([0])], {0: (np.zeros(1, np.uint64), np.zeros(1, np.int64))}
    links = []
    size = 1
    for k in range(1, depth + 1):
        own = np.unique(contexts[depths == k])
        keys, ids = place[k - 1]
        mask = np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (9 - k))) - 1)) if k > 1 else np.uint64(0)
        at = np.minimum(np.searchsorted(keys, own & mask), len(keys) - 1)
        fits = keys[at] == (own & mask)
        own, above = own[fits], ids[at[fits]]
        ids = size + np.arange(len(own))
        place[k] = (own, ids) if len(own) else (np.full(1, np.uint64(2**64 - 1)), np.zeros(1, np.int64))
        links.append((above, (own >> np.uint64(8 * (8 - k))) & np.uint64(255), ids))
        parents.append(above)
        levels.append(np.full(len(own), k))
        size += len(own)
        if not len(own):
            break
    parent, level = np.concatenate(parents), np.concatenate(levels)
    splits = np.zeros(size, bool)
    splits[parent[1:]] = True
    number = np.empty(size, np.int64)
    number[np.argsort(~splits, kind="stable")] = np.arange(size)
    child = np.full((int(splits.sum()) + 1, len(seen) + 1), size, np.int32)
    for above, byte, ids in links:
        child[number[above], column[byte.astype(np.int64)]] = number[ids]
    order = np.argsort(number)
    above = np.where(parent < 0, -1, number[parent])
    return Tree(child, above[order], level[order], column)


def _following(tree: Tree, depth: int):
    """How often each byte follows each deepest node."""

    def count(batches):
        total, held = np.zeros(tree.states * tree.width, np.uint32), 0

        def counts() -> pa.RecordBatch:
            cell = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

        for block in blocks(batches, BLOCK):
            words, numbers = split_words(block["text"], lower=True)
            data, counted, _ = stream(normal_texts(words, numbers), depth)
            if held + len(data) >= 1 << 32:  # more than a count holds
                yield counts()
                total[:], held = 0, 0
            np.add.at(total, tree.cells(data, depth)[counted], np.uint32(1))
            held += len(data)
        yield counts()

    return count


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after six steps up."""
    y = x + 6.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return series - np.log(product)


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of 256 byte counts: zeros and ones at each of the 255 decisions (index 1 to 255)."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for j in (128, 64, 32, 16, 8, 4, 2, 1):
        heap[:, j:2 * j] = heap[:, 2 * j:4 * j:2] + heap[:, 2 * j + 1:4 * j:2]
    return heap[:, 0::2][:, :256], heap[:, 1::2][:, :256]


def _decisions() -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each byte, and which way it goes at each."""
    byte = np.arange(256)[:, None]
    bit = np.arange(7, -1, -1)[None, :]
    return (1 << (7 - bit)) | (byte >> (bit + 1)), (byte >> bit) & 1


@dataclass(frozen=True)
class Outline:
    """A tree without its links: what weights are computed from, small enough to go with every task."""

    parent: np.ndarray
    level: np.ndarray
    column: np.ndarray
    inner: int
    width: int

    @classmethod
    def of(cls, tree: Tree) -> Outline:
        return cls(tree.parent.astype(np.int32), tree.level.astype(np.int8), tree.column, tree.inner, tree.width)


class Nodes:
    """Some of a tree's nodes, one of them above all others: counts and weighted probabilities from below, mixtures from above.

    ``ids`` are ascending, so states with children come first. ``following`` are the counts by deepest node and column.
    """

    def __init__(self, tree: Outline, ids: np.ndarray, following: np.ndarray, rows: int = 2048) -> None:
        self._tree, self._following, self._rows = tree, following, rows
        self._inner = int(np.searchsorted(ids, tree.inner))
        above = tree.parent[ids]
        self._parent = np.where(above < ids[0], -1, np.searchsorted(ids, above)) if len(ids) else above
        level = tree.level[ids]
        self._levels = [np.flatnonzero(level == k) for k in range(level.min(), level.max() + 1)]
        self._seen = np.flatnonzero(tree.column < tree.width - 1)
        self._unseen = np.flatnonzero(tree.column == tree.width - 1)
        # All counts of states with children; a leaf's are those that follow it.
        self.total = following[: self._inner].astype(np.float64)
        self.below = np.zeros((self._inner, 256))
        self._weight = np.ones((self._inner, 256), np.float32)

    def _split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros((len(own), 256))
        whole[:, self._seen] = own[:, : len(self._seen)]
        return _halves(whole)

    def _parts(self, ids: np.ndarray):
        """The nodes of a level a few at a time, those with children apart from leaves."""
        for chosen in (ids[ids < self._inner], ids[ids >= self._inner]):
            for i in range(0, len(chosen), self._rows):
                yield chosen[i:i + self._rows], chosen[0] < self._inner

    def _counts(self, part: np.ndarray, splits: bool) -> np.ndarray:
        return self.total[part] if splits else self._following[part].astype(np.float64)

    def gather(self) -> tuple[np.ndarray, np.ndarray]:
        """Bottom up: the counts and the logarithms of the weighted probabilities of the node above all others."""
        top = None
        for ids in reversed(self._levels):
            for part, splits in self._parts(ids):
                counts = self._counts(part, splits)
                mixed = log_kt(*self._split(counts))
                if splits:
                    # What stays at a node with children is one more child, a leaf.
                    divided = self.below[part] + log_kt(*self._split(self._following[part]))
                    both = np.logaddexp(mixed, divided) - np.log(2)
                    self._weight[part] = np.exp(mixed - np.log(2) - both)
                    mixed = both
                if self._parent[part[0]] < 0:
                    top = counts[0], mixed[0]
                else:
                    np.add.at(self.below, self._parent[part], mixed)
                    np.add.at(self.total, self._parent[part], counts)
        return top

    def predict(self, base: np.ndarray, share: np.ndarray):
        """Top down, after ``gather``: nodes and the log2 probability of each column's byte at each of them.

        ``base`` is what the nodes above give to a one, ``share`` what they leave to the nodes here.
        """
        carried, left = (np.ones((self._inner, 256), np.float32) for _ in range(2))
        where, way = _decisions()
        for ids in self._levels:
            for part, splits in self._parts(ids):
                given, rest = base[None], share[None]
                if self._parent[part[0]] >= 0:
                    given, rest = carried[self._parent[part]], left[self._parent[part]]
                zeros, ones = self._split(self._counts(part, splits))
                estimate = (ones + 0.5) / (zeros + ones + 1.0)
                if splits:
                    own = self._weight[part]
                    carried[part], left[part] = given + rest * own * estimate, rest * (1 - own)
                    zeros, ones = self._split(self._following[part])
                    one = carried[part] + left[part] * (ones + 0.5) / (zeros + ones + 1.0)
                else:
                    one = given + rest * estimate
                one = np.clip(one, 1e-9, 1 - 1e-9)
                code = np.zeros((len(part), 256))
                for bit in range(8):
                    chance = one[:, where[:, bit]]
                    code += np.log2(np.where(way[:, bit], chance, 1 - chance))
                out = np.empty((len(part), self._tree.width), np.float32)
                out[:, :-1] = code[:, self._seen]
                # Bytes never met share the least of their probabilities, so that no more than 1 is given away.
                out[:, -1] = code[:, self._unseen].min(axis=1, initial=0)
                yield part, out

    def passed_on(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first node gives to a one, and what it leaves to the nodes below it."""
        zeros, ones = self._split(self.total[:1])
        return (self._weight[0] * (ones[0] + 0.5) / (zeros[0] + ones[0] + 1.0)).astype(np.float32), 1 - self._weight[0]


def branches(tree: Tree) -> np.ndarray:
    """For each node the node of depth 1 above it, itself included; the root is its own."""
    branch = np.arange(tree.states)
    for k in range(2, tree.level.max() + 1):
        ids = np.flatnonzero(tree.level == k)
        branch[ids] = branch[tree.parent[ids]]
    return branch


def predictions(tree: Tree, following: np.ndarray) -> np.ndarray:
    """log2 probability of each column's byte at each deepest node, mixed over all depths: the whole tree at once."""
    whole = Nodes(Outline.of(tree), np.arange(tree.states), following)
    whole.gather()
    out = np.zeros((tree.states, tree.width), np.float32)
    for part, rows in whole.predict(np.zeros(256, np.float32), np.ones(256, np.float32)):
        out[part] = rows
    return out


def _branch(tree: Outline, branch: np.ndarray, cells: pa.Table) -> tuple[np.ndarray, Nodes]:
    ids = np.flatnonzero(branch == cells["branch"][0].as_py())
    following = np.zeros((len(ids), tree.width), np.int64)
    cell = cells["cell"].to_numpy()
    following[np.searchsorted(ids, cell // tree.width), cell % tree.width] = cells["n"].to_numpy()
    return ids, Nodes(tree, ids, following)


def _gathered(tree: Outline, branch: np.ndarray):
    """Counts and weighted probabilities of a branch's first node."""

    def gather(cells: pa.Table) -> pa.Table:
        ids, nodes = _branch(tree, branch, cells)
        total, mixed = nodes.gather()
        return pa.table({
            "branch": pa.array([int(ids[0])]), "total": pa.array([total.tolist()], pa.list_(pa.float64())),
            "mixed": pa.array([mixed.tolist()], pa.list_(pa.float64())),
        })

    return gather


def _predicted(tree: Outline, branch: np.ndarray, base: np.ndarray, share: np.ndarray):
    """Every node of a branch with its row of log2 probabilities."""

    def predict(cells: pa.Table) -> pa.Table:
        ids, nodes = _branch(tree, branch, cells)
        nodes.gather()
        out = np.empty((len(ids), tree.width), np.float32)
        for part, rows in nodes.predict(base, share):
            out[part] = rows
        del nodes
        ends = (np.arange(len(ids) + 1) * 4 * tree.width).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(out)])
        give_back()
        return pa.table({"node": pa.array(ids), "log2": held.cast(pa.binary())})

    return predict


def branch_predictions(tree: Tree, cells: DataFrame) -> np.ndarray:
    """The same as ``predictions``, a task for each branch below the root.

    ``cells`` (``cell``, ``n``) stay distributed. Branches meet in the root only: a first pass gives the counts and
    weighted probabilities of each, a second carries the root's mixture down into them.
    """
    branch, outline = branches(tree).astype(np.int32), Outline.of(tree)
    # A branch has at least one row, also where nothing follows its nodes.
    firsts = np.unique(branch).tolist()
    every = cells.sparkSession.createDataFrame([(f * tree.width, 0) for f in firsts], "cell long, n long")
    named, width = pa.array(branch), tree.width

    def name(batches):
        for b in batches:
            of = named.take(pa.array(b["cell"].to_numpy() // width))
            yield pa.RecordBatch.from_arrays([of, b["cell"], b["n"]], names=["branch", "cell", "n"])

    rows = cells.unionByName(every).groupBy("cell").agg(F.sum("n").alias("n"))
    rows = cut_lineage(rows.mapInArrow(name, "branch int, cell long, n long"))
    below = rows.filter(F.col("branch") > 0).groupBy("branch")
    firsts = below.applyInArrow(_gathered(outline, branch), "branch long, total array<double>, mixed array<double>").toArrow()
    own = rows.filter(F.col("branch") == 0).toArrow()
    following = np.zeros((1, tree.width), np.int64)
    following[0, own["cell"].to_numpy()] = own["n"].to_numpy()
    root = Nodes(outline, np.zeros(1, np.int64), following)
    if tree.inner:
        for total, mixed in zip(firsts["total"].to_pylist(), firsts["mixed"].to_pylist()):
            root.total[0] += total
            root.below[0] += mixed
    root.gather()
    out = np.zeros((tree.states, tree.width), np.float32)
    for part, found in root.predict(np.zeros(256, np.float32), np.ones(256, np.float32)):
        out[part] = found
    if tree.inner:
        done = below.applyInArrow(_predicted(outline, branch, *root.passed_on()), "node long, log2 binary")
        for part in done.toArrow().to_batches():
            out[part["node"].to_numpy()] = np.frombuffer(b"".join(part["log2"].to_pylist()), np.float32).reshape(-1, tree.width)
    return out


@dataclass(frozen=True)
class Model:
    tree: Tree
    log2: np.ndarray
    depth: int

    def score(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each text, and its bytes with the end."""
        data, counted, size = stream(normal_texts(words, counts), self.depth)
        cell = self.tree.cells(data, self.depth)[counted]
        return per_text(self.log2.ravel()[cell].astype(np.float64), size), size


def node_share(size: int) -> float:
    """Part of a corpus of ``size`` bytes that a context must make up to have a node."""
    return 1 / (NODES * max(1, size) ** 0.25)


def train(texts: DataFrame, size_hint: int, depth: int = DEPTH) -> Model:
    """A tree over all of ``texts`` (column ``text``); ``size_hint`` is about their number of bytes."""
    share = node_share(size_hint)
    found = mapped(texts, _contexts(share, depth), "depth int, context long, n long")
    found = cut_lineage(found.groupBy("depth", "context").agg(F.sum("n").alias("n")))
    total = found.filter("depth = 0").agg(F.sum("n")).head()[0] or 0
    # Blocks where a context holds less than half the share count none of it; one that holds the share over all
    # has at least half of its count in the other blocks, however it is spread.
    rows = found.filter((F.col("depth") > 0) & (F.col("n") * 2 >= share * total)).select("depth", "context").toArrow()
    met = found.filter("depth = -1").select("context").toArrow()["context"].to_numpy()
    tree = grow(rows["depth"].to_numpy(), rows["context"].to_numpy().view(np.uint64), depth, np.sort(met))
    counted = mapped(texts, _following(tree, depth), "cell long, n long")
    return Model(tree, branch_predictions(tree, counted), depth)

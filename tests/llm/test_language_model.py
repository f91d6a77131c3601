import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.llm import ctw, full_tree, language_model
from gleanery.llm.common import document_key, split_words

from .conftest import DOCUMENTS, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def normal(text):
    return " ".join(tokens(text)).encode()


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """Context-tree weighting of whole byte contexts by recursion, one decision at a time."""

    def __init__(self, texts, contexts, depth):
        self.contexts, self.depth = contexts, depth
        self.own, self.all = collections.Counter(), collections.Counter()
        for text in texts:
            data = bytes([ctw.END] * depth) + normal(text) + bytes([ctw.END])
            for i in range(depth, len(data)):
                node = self.node(data, i)
                for bit in range(8):
                    key = (1 << bit) | (data[i] >> (8 - bit))
                    one = (data[i] >> (7 - bit)) & 1
                    self.own[node, key, one] += 1
                    for k in range(len(node) + 1):
                        self.all[node[:k], key, one] += 1

    def node(self, data, i):
        node = ()
        for k in range(1, self.depth + 1):
            if node + (data[i - k],) not in self.contexts:
                break
            node += (data[i - k],)
        return node

    def weighted(self, node, key):
        whole = log_kt(self.all[node, key, 0], self.all[node, key, 1])
        below = [c for c in self.contexts if len(c) == len(node) + 1 and c[:-1] == node]
        if not below:
            return whole, 1.0
        split = log_kt(self.own[node, key, 0], self.own[node, key, 1]) + sum(self.weighted(c, key)[0] for c in below)
        both = np.logaddexp(whole, split) - math.log(2)
        return both, math.exp(whole - math.log(2) - both)

    def log2(self, text):
        data = bytes([ctw.END] * self.depth) + normal(text) + bytes([ctw.END])
        total = 0.0
        for i in range(self.depth, len(data)):
            node = self.node(data, i)
            for bit in range(8):
                key, one = (1 << bit) | (data[i] >> (8 - bit)), (data[i] >> (7 - bit)) & 1
                chance, left = 0.0, 1.0
                for k in range(len(node) + 1):
                    w = self.weighted(node[:k], key)[1]
                    a, b = self.all[node[:k], key, 0], self.all[node[:k], key, 1]
                    chance, left = chance + left * w * (b + 0.5) / (a + b + 1), left * (1 - w)
                a, b = self.own[node, key, 0], self.own[node, key, 1]
                chance += left * (b + 0.5) / (a + b + 1)
                total += math.log2(chance if one else 1 - chance)
        return total


def test_tree_agrees_with_recursion():
    texts, depth = ["abba ab", "b a abab", "Abba  ba"], 3
    contexts = {(97,), (98,), (32,), (97, 98), (98, 97), (97, 98, 98), (255,)}
    plain = PlainTree(texts, contexts, depth)
    codes = [sum(b << (8 * (7 - k)) for k, b in enumerate(c)) for c in contexts]
    seen = np.array(sorted({ctw.END, *b"ab "}))
    tree = ctw.grow(np.array([len(c) for c in contexts]), np.array(codes, np.uint64), depth, seen)
    assert tree.states == len(contexts) + 1
    following = np.zeros((tree.states, tree.width), np.int64)
    for part in ctw._following(tree, depth)(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        following.ravel()[part["cell"].to_numpy()] += part["n"].to_numpy()
    model = ctw.Model(tree, ctw.predictions(tree, following), depth)
    for text in [*texts, "", "bab aab"]:
        got = model.score(*split_words(pa.array([text]), lower=True))[0][0]
        assert abs(got - plain.log2(text)) < 1e-3
    # No more than 1 is given away, the unseen bytes' share counted for each of them.
    given = np.exp2(model.log2[:, :-1].astype(float)).sum(axis=1) + (256 - len(seen)) * np.exp2(model.log2[:, -1].astype(float))
    assert (given <= 1 + 1e-5).all()


def test_branches_agree_with_the_whole_tree(spark):
    """The same probabilities, bit for bit but for the order of sums, whether nodes are worked on at once or by branch."""
    texts, depth = [prose(i, 200) for i in range(20)], 4
    for share in (0.002, 0.9):
        found = pa.Table.from_batches(ctw._contexts(share, depth)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
        level, codes = found["depth"].to_numpy(), found["context"].to_numpy().view(np.uint64)
        tree = ctw.grow(level[level > 0], codes[level > 0], depth, np.sort(codes[level < 0]).astype(np.int64))
        cells = pa.Table.from_batches(ctw._following(tree, depth)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
        following = np.zeros((tree.states, tree.width), np.int64)
        following.ravel()[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        rows = spark.createDataFrame(list(zip(cells["cell"].to_pylist(), cells["n"].to_pylist())), "cell long, n long")
        assert np.allclose(ctw.branch_predictions(tree, rows), ctw.predictions(tree, following), atol=1e-5)
        assert (tree.states > 100) == (share < 0.9)


def test_logarithm_of_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e9])
    assert np.allclose(ctw._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-8, atol=1e-8)


def checked(rows, found):
    held = {k: zlib.crc32((b"" if i is None else str(i).encode())) % 10 == 0 for k, (i, _) in enumerate(rows)}
    count = collections.Counter(t for k, (_, text) in enumerate(rows) if not held[k] for t in [*tokens(text), None])
    total, kinds = sum(count.values()), len(count)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = []
    for k, (i, text) in enumerate(rows):
        own = [*tokens(text), None]
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        want.append((i, len(own), held[k], sum(count[t] > 0 for t in own), total, base))
    got = [(r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score) for r in found]
    for one, two in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert one[:5] == two[:5] and abs(one[5] - two[5]) < 1e-6 * max(1, abs(two[5]))
    assert all(r.score < 0 or r.n_tokens == 1 for r in found)


def test_scores_of_awkward_rows(awkward, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    held_out = F.pmod(document_key(), F.lit(10)) == 0
    checked(rows, language_model.score(awkward, held_out).collect())
    # The counts are the same where hardly any word is known to every executor.
    monkeypatch.setattr(language_model, "FREQUENT", 4)
    checked(rows, language_model.score(awkward, held_out).collect())


def test_no_training_texts_and_no_texts(awkward, nothing):
    rows = language_model.score(awkward, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in rows} == {(0, 0, 0.0)}
    assert language_model.score(nothing, F.lit(False)).count() == 0


def test_held_out_prose_is_cheaper_than_chance(spark):
    rows = [(i, prose(i, 300), "en", "s", 0) for i in range(150)]
    texts = spark.createDataFrame(rows, DOCUMENTS)
    found = language_model.score(texts, F.col("doc_id") % 10 == 0).filter("held_out").collect()
    bits = -sum(r.score for r in found) / math.log10(2) / sum(r.n_bytes for r in found)
    # Letters and spaces drawn alike would cost log2(20), over 4.3 bits; the syllables themselves about 2.4.
    assert bits < 2.9


def test_tree_grows_with_the_corpus(spark):
    texts = spark.createDataFrame([(prose(i, 700),) for i in range(100)], "text string").coalesce(1)
    # The same text stands for corpora of 20 MB and 30 GB.
    small, large = (ctw.train(texts, size, 4).tree.states for size in (2 * 10**7, 3 * 10**10))
    assert small < large


def test_lumpy_context_at_the_share_has_a_node(spark, monkeypatch):
    # Of 10 blocks of 1,000 bytes one holds "q" 50 times, the others, 3 times each, below half the share of 0.0077.
    monkeypatch.setattr(ctw, "NODES", 1 / 0.077)
    texts = [("q" * (50 if i == 0 else 3)).ljust(999, "a") for i in range(10)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], 10), "text string")
    tree = ctw.train(rows, 10_000, 1).tree
    assert tree.child[0, tree.column[ord("q")]] < tree.states


def all_contexts(texts, depth):
    data = [bytes([ctw.END] * depth) + normal(t) + bytes([ctw.END]) for t in texts]
    return {tuple(d[i - j] for j in range(1, k + 1)) for d in data for i in range(depth, len(d)) for k in range(1, depth + 1)}


def scores(rows, depth):
    found = language_model.score(rows, F.col("doc_id") % 10 == 0, depth).collect()
    return {r.doc_id: r.score / math.log10(2) for r in found}


def test_every_context_has_a_node(spark, monkeypatch):
    texts = {1: "abba ab", 2: "b a abab", 3: "Abba  ba", 4: "c\u00e9 ab", 10: "bab aab cz\u00e9", 20: None, 30: "\u4e2d zzz zzz"}
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCUMENTS)
    training = [t for i, t in texts.items() if i % 10]
    plain = PlainTree(training, all_contexts(training, 3), 3)
    # The same on one part with all grams known, on many parts, and with no gram known.
    for part, known in ((1 << 18, 1 << 21), (4, 8), (1, 0)):
        monkeypatch.setattr(full_tree, "PART", part)
        monkeypatch.setattr(full_tree, "KNOWN", known)
        monkeypatch.setattr(full_tree, "PLACES", 16 if known < 9 else 1 << 20)
        monkeypatch.setattr(full_tree, "HELD", 16 if known < 9 else 1 << 20)
        got = scores(rows, 3)
        for i, text in texts.items():
            assert abs(got[i] - plain.log2(text or "")) < 1e-4


def test_contexts_below_the_share_count(spark):
    """On 700 KB a context met fewer than six times was held together with others."""
    # Each number stands in three or four texts.
    texts = [" ".join([prose(i, 1_200), *(str(i % 30 * 7919 + j * 104729) for j in range(20))]) for i in range(101)]
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCUMENTS)
    training, depth = [t for i, t in enumerate(texts) if i % 10], 4
    found = pa.Table.from_batches(ctw._contexts(0.0, depth)(iter([pa.RecordBatch.from_pydict({"text": training})])))
    level, codes = found["depth"].to_numpy(), found["context"].to_numpy().view(np.uint64)
    tree = ctw.grow(level[level > 0], codes[level > 0], depth, np.sort(codes[level < 0]).astype(np.int64))
    following = np.zeros((tree.states, tree.width), np.int64)
    for part in ctw._following(tree, depth)(iter([pa.RecordBatch.from_pydict({"text": training})])):
        following.ravel()[part["cell"].to_numpy()] += part["n"].to_numpy()
    whole = ctw.Model(tree, ctw.predictions(tree, following), depth)
    want = whole.score(*split_words(pa.array(texts), lower=True))[0]
    got = scores(rows, depth)
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)


def test_grams_that_begin_alike_keep_their_own_probabilities():
    """Whatever the order of the spread numbers, each place gets its own gram's probability, or is handed out."""
    texts = pa.array([prose(i, 300) for i in range(3)])
    words, counts = split_words(texts)
    gram, size = full_tree.grams(ctw.normal_texts(words, counts), 6)
    own = np.unique(gram)[::2]
    spread = full_tree._spread(own)
    order = np.argsort(spread)
    held = full_tree.Known(spread[order], (own % np.uint64(97)).astype(np.float32)[order], 6)
    total, places, (owner, far, times) = held.score(words, counts)
    known = np.isin(gram, own)
    text = np.repeat(np.arange(3), size)
    assert np.allclose(total, np.bincount(text, np.where(known, (gram % np.uint64(97)).astype(float), 0)))
    want = collections.Counter(zip(text[~known].tolist(), gram[~known].tolist()))
    assert want == dict(zip(zip(owner.tolist(), far.tolist()), times.tolist())) and (places == size).all()


def met(texts, held_out, depth):
    rows = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "held_out": pa.array(held_out, pa.bool_())})
    return full_tree._met(depth)(iter([rows.slice(i, 1) for i in range(len(texts))]))


def test_places_are_counted_in_bounded_memory():
    """Grams that hardly repeat: one array, and batches that the other side can hold beside its own rows."""
    draw = np.random.default_rng(7)
    texts = ["".join(map(chr, draw.integers(ord("a"), ord("z") + 1, 500_000))) for _ in range(18)]
    want = np.concatenate([full_tree.grams(pa.array([t]), 6)[0] for t in texts])
    want, places = int(want.sum()), len(want)
    tracemalloc.start()
    total, n, largest = 0, 0, 0
    for batch in met(texts, [False] * 18, 6):
        own = batch["n"].to_numpy()
        total += int((batch["gram"].to_numpy().view(np.uint64) * own.astype(np.uint64)).sum())
        n, largest = n + int(own.sum()), max(largest, batch.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total % (1 << 64), n) == (want, places)
    assert largest <= 4 << 20 and peak < 200 << 20


def test_places_beyond_one_number_and_none(monkeypatch):
    """Frequent grams take several numbers, grams of held-out texts alone none of the places, on any borders."""
    texts = ["ab" * 700, "x" * 1_300, None, "ab" * 40, "", "ba yes", "ab" * 300]
    held_out = [False, False, False, True, False, True, None]
    want = collections.Counter()
    for text, out in zip(texts, held_out):
        for gram in full_tree.grams(pa.array([normal(text).decode()]), 3)[0].tolist():
            want[gram] += 0 if out is not False else 1
    for places, held, rows in ((1 << 12, 1 << 11, 1 << 17), (256, 16, 7), (64, 64, 1)):
        for name, value in (("PLACES", places), ("HELD", held), ("PIECE_ROWS", rows)):
            monkeypatch.setattr(full_tree, name, value, raising=False)
        got = collections.Counter()
        for batch in met(texts, held_out, 3):
            assert 0 < batch.num_rows <= rows
            for gram, n in zip(batch["gram"].to_pylist(), batch["n"].to_pylist()):
                got[gram] += n
        assert dict(got) == dict(want)


def test_places_outside_the_known_grams_take_bounded_memory():
    """Where hardly a gram is known, a block's places are handed out by text and gram in little more than they take."""
    draw = np.random.default_rng(8)
    texts = ["".join(map(chr, draw.integers(ord("a"), ord("z") + 1, n))) for n in [4_000] * 500]
    words, counts = split_words(pa.array([*texts, None, "aaaaaaaaaaaa " * 3]))
    held = full_tree.Known(np.zeros(0, np.uint64), np.zeros(0, np.float32), 6)
    tracemalloc.start()
    total, size, (owner, far, times) = held.score(words, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gram, places = full_tree.grams(ctw.normal_texts(words, counts), 6)
    want = collections.Counter(zip(np.repeat(np.arange(502), places).tolist(), gram.tolist()))
    assert list(zip(owner.tolist(), far.tolist(), times.tolist())) == [(*k, n) for k, n in sorted(want.items())]
    assert not total.any() and (size == places).all()
    assert peak < 150 << 20, peak >> 20

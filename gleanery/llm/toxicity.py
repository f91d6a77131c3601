"""Class-conditional Kneser-Ney models: is a text likelier among toxic or among ordinary ones?

An expression is a lower-cased word without its punctuation. Each class has a model of its
own, the probability of an expression after the one before it, interpolated down a chain:

* the pair's count in the class, less a discount below 1, over the count of its first expression;
* the expression's number of different predecessors in the class, discounted alike;
* the number of the class's different expressions that share its beginning, for each length in
  ``STEMS`` from the longest on.

What a step's discount takes is shared out over the step below; how a beginning's share
is split between the expressions that have it is told by counts which both classes share.
At the end of the chain stand the shared counts alone, so a rare expression says in
both models what its relatives say, and one without relatives next to nothing. Each model's
probabilities add up to one, with one unknown expression for each beginning. Pairs met
fewer than ``LEAST_PAIR`` times in both classes leave their whole share to the step below.

A text's evidence is the difference of its two log-likelihoods by length. An expression's difference
is a sum over the chain's steps; what steps with more than ``TOLD`` counts add is its told part. The told part,
by length, and that of strongly one-sided expressions, by length and by the root of the length, are evidence
as well: a step with few counts is as likely chance as not. A logistic curve, fitted on rows that the models did
not see, weighs the four and gives the score.

The models are fitted on at most ``SAMPLE`` labelled rows of each class, taken in the order
of a hash; all counts are made by Spark, and all documents are scored whole. What the driver
and the tasks hold grows with the words of that sample, not with the corpus.

Defined cases: null and empty texts have no evidence and score as the curve says at zero;
null labels are no labels; without both classes every score is 0; repeated documents get equal
scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, hash_words, in_pieces, mapped, mixed, signed, split_words
from gleanery.llm.preference import labelled_sample
from gleanery.llm.text_stats import per_text, word_codes
from gleanery.session import cut_lineage

SAMPLE = 4_000
LEAST_PAIR = 2
TOLD = 3
#: Lengths of the beginnings that expressions share.
STEMS = (3, 4, 5, 6)
#: Evidence (natural logarithm) from which an expression is one-sided.
STRONG = 2.0
TRIMMED = ".,;:!?\"'()[]{}*#$%&|<>"
PAIRS = "before long, own long, pair long, expression string, fold int, toxic int, n long"
ACCEPT = 0.3
_PAIRING = np.uint64(0xC2B2AE3D27D4EB4F)


def _expressions(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each expression met, the expression of each code, and how many each text has."""
    words, counts = split_words(texts, lower=True)
    codes, dictionary = word_codes(words)
    names = pc.utf8_trim(dictionary, TRIMMED)
    told = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[codes]
    return codes[told], names, per_text(told.astype(np.int64), counts)


def _pairs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the expression before each one (0 at a text's start), and of the two together."""
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])[: len(hashes)]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    with np.errstate(over="ignore"):
        return before, mixed(before * _PAIRING + hashes)


def _counted(batches):
    for block in blocks(batches):
        fold, toxic = block["_fold"].to_numpy(), block["_label"].to_numpy()
        for f in (0, 1):
            for t in (0, 1):
                codes, names, counts = _expressions(block["text"].take(pa.array(np.flatnonzero((fold == f) & (toxic == t)))))
                own = hash_words(names)[codes]
                before, pair = _pairs(own, counts)
                pair, at, n = np.unique(pair, return_index=True, return_counts=True)
                hashes = [pa.array(signed(v)) for v in (before[at], own[at], pair)]
                same = [pa.array(np.full(len(at), v, np.int32)) for v in (f, t)]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, names.take(pa.array(codes[at])).cast(pa.string()), *same, pa.array(n.astype(np.int64))],
                    names=["before", "own", "pair", "expression", "fold", "toxic", "n"],
                )


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


Table = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Evidence:
    """Log-likelihood differences, toxic over ordinary, by sorted hash; whole in a first column, told in a second.

    ``tables`` has those of beginnings by length and of expressions (0) by themselves, ``pairs`` those of
    an expression after another, ``contexts`` what an expression adds to a next one that it is in no pair with.
    ``unknown`` is the difference of an expression without known beginnings.
    """

    tables: dict[int, Table]
    pairs: Table
    contexts: Table
    unknown: float

    def of(self, names: pa.Array) -> np.ndarray:
        """Told differences of expressions by themselves."""
        return self.alone(names)[:, 1]

    def alone(self, names: pa.Array) -> np.ndarray:
        """Of expressions by themselves."""
        out = np.tile([self.unknown, 0.0], (len(names), 1))
        for length, (keys, values) in self.tables.items():
            known, at = _found(keys, hash_words(pc.utf8_slice_codeunits(names, 0, length) if length else names))
            out[known] = values[at[known]]
        return out

    def each(self, codes: np.ndarray, names: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Of each expression of texts laid end to end, after the one before it."""
        hashes = hash_words(names)
        known, at = _found(self.contexts[0], hashes)
        left = np.zeros((len(names), 2))
        left[known, 0] = self.contexts[1][at[known]]
        begins = np.zeros(len(codes), bool)
        begins[(np.cumsum(counts) - counts)[counts > 0]] = True
        known, at = _found(self.contexts[0], np.zeros(1, np.uint64))
        start = [self.contexts[1][at[0]] if known[0] else 0.0, 0.0]
        carried = np.concatenate([np.zeros((1, 2)), left[codes][:-1]])[: len(codes)]
        carried[begins] = start
        out = self.alone(names)[codes] + carried
        known, at = _found(self.pairs[0], _pairs(hashes[codes], counts)[1])
        out[known] = self.pairs[1][at[known]]
        return out

    def inputs(self, texts: pa.Array) -> np.ndarray:
        """A row for the curve for each text."""
        codes, names, counts = _expressions(texts)
        whole, told = self.each(codes, names, counts).T
        n = np.maximum(counts, 1)
        strong = per_text(np.where(told > STRONG, told, 0.0), counts)
        means = [10 * per_text(v, counts) / n for v in (whole, told)]
        return np.column_stack([np.ones(len(n)), *means, 10 * strong / n, strong / np.sqrt(n)])


def _discount(once: float, twice: float) -> float:
    """The usual estimate from the counts of counts; a half where none was met once."""
    return once / (once + 2 * twice) if once and twice else 0.5


def _level(n: np.ndarray, parent: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both classes' probabilities of the units with counts ``n`` (a column a class), and the shares that fall back.

    ``parent`` is each unit's place in ``above``, the probabilities of the step below.
    """
    discount = _discount((n == 1).sum(), (n == 2).sum())
    total = np.maximum(n.sum(axis=0), 1)
    # A class without any count takes all from the step below.
    share = np.where(n.sum(axis=0) > 0, discount * (n > 0).sum(axis=0) / total, 1.0)
    both = n.sum(axis=1)
    among = np.bincount(parent, weights=both, minlength=len(above))
    split = (both - discount) / among[parent]
    return np.maximum(n - discount, 0) / total + share * above[parent] * split[:, None], share


def _sorted(keys: np.ndarray, values: np.ndarray) -> Table:
    order = np.argsort(keys)
    return keys[order], values[order]


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(p[:, 1]) - np.log(p[:, 0])


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _evidence(counted: DataFrame, folds: list[int]) -> Evidence:
    """Both models, from counts by Spark; the sample bounds what comes back."""
    n = [F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)]
    pairs = counted.filter(F.col("fold").isin(folds)).groupBy("pair", "before", "own")
    pairs = cut_lineage(pairs.agg(F.min("expression").alias("name"), *n))
    kinds = [F.sum((F.col(f"n{t}") > 0).cast("long")).alias(f"n{t}") for t in (0, 1)]
    words = pairs.groupBy("own").agg(F.min("name").alias("name"), *kinds).orderBy("own").toArrow()
    names, counts = words["name"].combine_chunks(), np.column_stack([words[c].to_numpy() for c in ("n0", "n1")])
    own = _unsigned(words["own"])

    above, told, parent_of = np.ones((1, 2)), np.zeros(1), np.zeros(len(names), np.int64)
    tables, falls = {}, []
    for length in (*STEMS, 0):
        if length:
            encoded = pc.utf8_slice_codeunits(names, 0, length).dictionary_encode()
            unit, units = encoded.indices.to_numpy(), encoded.dictionary
            n_level = np.column_stack([np.bincount(unit, weights=counts[:, t] > 0, minlength=len(units)) for t in (0, 1)])
            parent = np.zeros(len(units), np.int64)
            parent[unit] = parent_of
            keys = hash_words(units)
        else:
            unit, n_level, parent, keys = np.arange(len(names)), counts.astype(float), parent_of, own
        below = _odds(above)
        above, share = _level(n_level, parent, above)
        parent_of = unit
        told = told[parent] + np.where(n_level.sum(axis=1) > TOLD, _odds(above) - below[parent], 0.0)
        tables[length] = (keys, np.column_stack([_odds(above), told]))
        falls.append(np.log(share[1]) - np.log(share[0]))
    # An expression known by a beginning only falls back at each longer step.
    unknown = float(sum(falls))
    for i, (length, (keys, odds)) in enumerate(tables.items()):
        tables[length] = _sorted(keys, odds + [sum(falls[i + 1:]), 0.0])

    counted_once = [F.sum((F.col(f"n{t}") == k).cast("long")) for k in (1, 2) for t in (0, 1)]
    met = [v or 0 for v in pairs.agg(*counted_once).head()]
    discount = _discount(met[0] + met[1], met[2] + met[3])
    often = F.col("n0") + F.col("n1") >= LEAST_PAIR
    taken = [F.sum(F.when(often, F.greatest(F.col(f"n{t}") - discount, F.lit(0.0))).otherwise(0.0)).alias(f"k{t}") for t in (0, 1)]
    totals = [F.sum(f"n{t}").alias(f"n{t}") for t in (0, 1)]
    first = pairs.groupBy("before").agg(*totals, *taken).filter(F.col("k0") + F.col("k1") > 0).orderBy("before").toArrow()
    n_first, kept = (np.column_stack([first[f"{c}{t}"].to_numpy() for t in (0, 1)]).astype(float) for c in "nk")
    left = 1 - kept / np.maximum(n_first, 1)
    before = _unsigned(first["before"])
    order = np.argsort(before)
    before, n_first, left = before[order], n_first[order], left[order]

    seen = pairs.filter(often).select("pair", "before", "own", "n0", "n1").orderBy("pair").toArrow()
    by_hash = np.argsort(own)
    at = by_hash[_found(own[by_hash], _unsigned(seen["own"]))[1]] if len(own) else np.zeros(0, np.int64)
    after = _found(before, _unsigned(seen["before"]))[1]
    n_seen = np.column_stack([seen[c].to_numpy() for c in ("n0", "n1")]).astype(float)
    p = np.maximum(n_seen - discount, 0) / np.maximum(n_first[after], 1) + left[after] * above[at]
    whole = _odds(p)
    told = told[at] + np.where(n_seen.sum(axis=1) > TOLD, whole - _odds(above)[at], 0.0)
    found = _sorted(_unsigned(seen["pair"]), np.column_stack([whole, told]))
    return Evidence(tables, found, (before, _odds(left)), unknown)


@dataclass(frozen=True)
class Classifier:
    evidence: Evidence
    curve: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence.inputs(texts) @ self.curve, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    curve = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (weigh * (y - p)) - penalty * curve
        bend = (x * (weigh * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(curve))
        step = np.linalg.solve(bend, slope)
        curve += step
        if np.abs(step).max() < 1e-6:
            break
    return curve


def learn(documents: DataFrame, labels: DataFrame, chosen: Column, label: str = "toxic") -> Classifier | None:
    """Fit on the labelled rows that ``chosen`` (over ``doc_id``) admits."""
    sample, counts = labelled_sample(labels, label, chosen, SAMPLE)
    if not counts.get(0) or not counts.get(1):
        return None
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")
    # At most 2 * SAMPLE ids: safe to send everywhere, and no text is shuffled.
    met = cut_lineage(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "_label", "text", fold.alias("_fold")))
    counted = cut_lineage(mapped(met, _counted, PAIRS))
    half = _evidence(counted, [0])

    def weighed(batches):
        for block in blocks(batches):
            rows = half.inputs(block["text"])
            x = pa.array(list(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([block["doc_id"], block["_label"], x], names=["doc_id", "label", "x"])

    unseen = mapped(met.filter(F.col("_fold") == 1), weighed, "doc_id long, label int, x array<double>")
    # One row for each id of the sample, however often the id is repeated.
    rows = unseen.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("label", "x").toArrow()
    toxic = rows["label"].to_numpy().astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    # Rows stand for as many as their class has in all.
    weigh = np.where(toxic == 1, counts[1] / toxic.sum(), counts[0] / (len(toxic) - toxic.sum()))
    curve = _logistic(np.array(rows["x"].to_pylist()), toxic, weigh * len(toxic) / weigh.sum())
    return Classifier(_evidence(counted, [0, 1]), curve)


def score(text: Column, classifier: Classifier | None) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if classifier is None:
            return pa.array(np.zeros(len(texts)))
        return in_pieces(lambda own: pa.array(classifier.score(own)), texts)

    return scored(text)

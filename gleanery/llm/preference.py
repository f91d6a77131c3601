"""Bradley-Terry ranking of document quality.

A document's worth is a weighted sum of features of its text. The weights come from
preference pairs, a document marked good over one marked bad, by logistic loss on the
difference of their features. A document is accepted if its worth lies above a quantile of
the worths of all labelled rows: the share of bad documents among the labels.

Every labelled row that has a document takes part in the features' means, the pairs and the quantile. Pairs go by
places in the order of a hash: each row of the more frequent label meets at least ``ROUNDS`` rows of the other, which
are met equally often. Rows and pairs stay distributed; a step of the fit brings one row of sums a task to the driver.

Defined cases: null and empty texts have all features 0 and are scored like any other; a
null label is no label; without documents of both labels every score is ``ACCEPT``;
repeated documents get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, in_pieces, mapped
from gleanery.llm.text_stats import per_text, quality_counts
from gleanery.operators.ordered import row_positions, running_sum
from gleanery.session import cut_lineage

#: Pairs of each row of the more frequent label: at least the first, more up to the second where there are few rows.
ROUNDS, MOST_ROUNDS = 4, 64
#: Pairs that a small table is filled up to.
PAIRS = 60_000
PENALTY = 1e-3
ACCEPT = 0.3


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; shares, and their logarithms, so that small shares count."""
    found = quality_counts(texts)
    n, codes = found["n_words"], found["codes"]
    words, chars = np.maximum(n, 1), np.maximum(found["classes"].sum(axis=1), 1)
    owner = np.repeat(np.arange(len(n)), n)
    twice = np.zeros(len(codes), bool)
    twice[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.bincount(np.unique((owner << 32) | codes) >> 32, minlength=len(n))
    dictionary = found["dictionary"]
    size = np.diff(np.frombuffer(dictionary.buffers()[1], np.int32)[dictionary.offset:dictionary.offset + len(dictionary) + 1])
    short = per_text((size[codes] <= 3).astype(np.int64), n) if len(codes) else np.zeros(len(n))
    shares = np.column_stack([
        found["classes"] / chars[:, None],
        found["n_symbols"] / words,
        found["n_dup_lines"] / np.maximum(found["n_lines"], 1),
        found["n_repeat_words"] / words,
        per_text(twice.astype(np.int64), n) / words,
        distinct / words,
        short / words,
        found["word_chars"] / words / 10,
    ])
    return np.column_stack([shares, np.log(shares + 0.01), np.log1p(n), np.log1p(n) ** 2])


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the worth from which a document is accepted."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def worth(self, rows: np.ndarray) -> np.ndarray:
        return standard(rows, self.mean, self.spread) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``ACCEPT`` at the cut, and there by the log-odds of being preferred to it."""
        odds = self.worth(rows) - self.cut + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def standard(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / spread, -6, 6)


def _slopes(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number, slope and curvature of the logistic loss of pairs, summed, in one row."""
    lost = 1 / (1 + np.exp(np.clip(pairs @ weights, -30, 30)))
    curve = (pairs * (lost * (1 - lost))[:, None]).T @ pairs
    return np.concatenate([[len(pairs)], pairs.T @ lost, curve.ravel()])


def _newton(width: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights of the least loss; ``sums`` gives ``_slopes`` over all pairs at some weights."""
    weights = np.zeros(width)
    for _ in range(25):
        found = sums(weights)
        slope = found[1:width + 1] / found[0] - PENALTY * weights
        curve = found[width + 1:].reshape(width, width) / found[0] + PENALTY * np.eye(width)
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(rows: np.ndarray, good: np.ndarray, bad_share: float) -> Ranking:
    """Weights from pairs of a good and a bad row of one block; ``bad_share`` is the quantile of the cut."""
    draw = np.random.default_rng(7)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = standard(rows, mean, spread)
    pairs = x[draw.choice(np.flatnonzero(good), PAIRS)] - x[draw.choice(np.flatnonzero(~good), PAIRS)]
    weights = _newton(x.shape[1], lambda weights: _slopes(pairs, weights))
    worth = x @ weights
    # The sample holds each label in its own share: weigh its rows back before taking the quantile.
    weigh = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(worth)
    below = np.cumsum(weigh[order])
    k = int(np.searchsorted(below, bad_share - 1e-12))
    k = min(max(k, 0), len(order) - 2)
    return Ranking(mean, spread, weights, float((worth[order[k]] + worth[order[k + 1]]) / 2))


def labelled(labels: DataFrame, label: str, chosen: Column) -> tuple[DataFrame, dict[int, int]]:
    """Ids with their label, one row for each id, and how many there are of each label."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & chosen)
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    rows = rows.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    return rows, {row["_label"]: row["n"] for row in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}


def labelled_sample(labels: DataFrame, label: str, chosen: Column, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``limit`` ids of each label, in the order of a hash, and how many there are in all."""
    rows, counts = labelled(labels, label, chosen)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [rows.filter(F.col("_label") == k).orderBy(*order).limit(limit) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def _with_features(batches):
    for block in blocks(batches):
        x = pa.array(list(features(block["text"])), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([block["doc_id"], x], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``value`` makes of blocks of ``x``, summed over all rows."""

    def add(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + value(_matrix(batch["x"]))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return np.sum([row["total"] for row in mapped(rows.select("x"), add, "total array<double>").collect()], axis=0)


def _pairs(rows: DataFrame, met: dict[int, int], mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """``x``: standard features of a good row less those of a bad one."""
    many = int(met[1] >= met[0])
    few = met[1 - many]
    rounds = min(MOST_ROUNDS, max(ROUNDS, -(-PAIRS // met[many])))
    placed = row_positions(rows, ["label"], [F.xxhash64("doc_id"), F.col("doc_id")], None, "_place")
    other = placed.filter(F.col("label") == 1 - many).select((F.col("_place") - 1).alias("_other"), F.col("x").alias("_x"))
    each = placed.filter(F.col("label") == many).select("x", "_place", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
    partner = F.pmod(F.col("_place") + F.col("_round") * (few // rounds + 1), F.lit(few)).cast("long")
    joined = each.withColumn("_other", partner).join(other.withColumn("_other", F.col("_other").cast("long")), "_other")
    sign = 1 if many else -1

    def less(batches):
        for batch in batches:
            own, met_row = (standard(_matrix(batch[c]), mean, spread) for c in ("x", "_x"))
            yield pa.RecordBatch.from_arrays([pa.array(list(sign * (own - met_row)), pa.list_(pa.float64()))], names=["x"])

    return mapped(joined.select("x", "_x"), less, "x array<double>")


def _cut(rows: DataFrame, ranking: Ranking, counts: dict[int, int], met: dict[int, int]) -> float:
    """The worth between the last row that the share of bad labels covers and the next one."""

    def told(batches):
        for batch in batches:
            worth = pa.array(ranking.worth(_matrix(batch["x"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], worth], names=["doc_id", "label", "worth"])

    # Labels may lack a document: rows are weighed to the labels' own shares, in whole numbers.
    weigh = [F.lit(Decimal(counts[0] * met[1])), F.lit(Decimal(counts[1] * met[0]))]
    weighed = mapped(rows, told, "doc_id long, label int, worth double").select(
        F.lit(0).alias("_all"), "worth", "doc_id", F.when(F.col("label") == 1, weigh[1]).otherwise(weigh[0]).cast("decimal(38,0)").alias("_weight")
    )
    below = cut_lineage(running_sum(weighed, ["_all"], [F.col("worth"), F.col("doc_id")], None, "_weight", "_below").select("worth", "_below"))
    covered = F.lit(Decimal(counts[0] * met[0] * met[1])).cast("decimal(38,0)")
    two = below.filter(F.col("_below") >= covered).orderBy("_below").limit(2).collect()
    if len(two) < 2:
        two = below.orderBy(F.desc("_below")).limit(2).collect()
    return float(two[0]["worth"] + two[1]["worth"]) / 2


def learn(documents: DataFrame, labels: DataFrame, chosen: Column, label: str = "quality") -> Ranking | None:
    """Fit on all labelled rows that ``chosen`` (over ``doc_id``) admits."""
    named, counts = labelled(labels, label, chosen)
    if not counts.get(0) or not counts.get(1):
        return None
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Features meet the labels, so that no text is shuffled. One row for each id, however often the id is repeated.
    found = mapped(texts, _with_features, "doc_id long, x array<double>").join(named, "doc_id")
    rows = cut_lineage(found.groupBy("doc_id", F.col("_label").alias("label")).agg(F.min("x").alias("x")))
    met = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not met.get(0) or not met.get(1):
        return None
    n = met[0] + met[1]
    mean = _summed(rows, lambda x: x.sum(axis=0)) / n
    spread = np.sqrt(_summed(rows, lambda x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-6
    pairs = cut_lineage(_pairs(rows, met, mean, spread))
    # Sums differ in their last digits with the partitions; the rest of the digits are those of any run.
    weights = np.round(_newton(len(mean), lambda weights: _summed(pairs, lambda x: _slopes(x, weights))), 9)
    return Ranking(mean, spread, weights, _cut(rows, Ranking(mean, spread, weights, 0.0), counts, met))


def score(text: Column, ranking: Ranking | None) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if ranking is None:
            return pa.array(np.full(len(texts), ACCEPT))
        return in_pieces(lambda own: pa.array(ranking.score(features(own))), texts)

    return scored(text)

"""Scores of all texts by a context tree, beside a smoothed word model as the base.

The base counts words (A-Z lower-cased) and one end for each training text. Words that
make up at least one millionth part of all tokens are known to every executor; there are at
most ``FREQUENT`` of them. The other words of each text meet their counts in a join, so the vocabulary may be
of any size and no hot word is shuffled.

Words are told apart by a 64-bit hash. Defined cases: a null text is empty and holds its end
alone; without training texts every token's base is log10(1) and the tree is uniform; repeated documents
are scored each for itself.

The tree has a node for each context of the training texts. What it says about the most frequent contexts goes with the
tasks that score; the other places of each text meet their probabilities in a join, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, hash_words, mapped, signed, split_words
from gleanery.llm.ctw import BLOCK, DEPTH
from gleanery.llm.full_tree import Known, known, predictions
from gleanery.llm.text_stats import per_text, word_codes
from gleanery.session import cut_lineage

FREQUENT = 1 << 20
SMOOTHING = 0.1

SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "n_bytes long, rare array<long>, rare_n array<int>, far array<long>, far_n array<int>"
)


def _word_counts(batches):
    for block in blocks(batches, BLOCK):
        codes, dictionary = word_codes(split_words(block["text"], lower=True)[0])
        n = np.bincount(codes, minlength=len(dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(hash_words(dictionary))), pa.array(n)], names=["word", "n"])


def _lists(owner: np.ndarray, rows: int, *values: pa.Array) -> list[pa.Array]:
    """Values of ascending owners as a list for each of the rows."""
    borders = pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(borders, v) for v in values]


def _scored(tree: Known, words_known: np.ndarray, log_known: np.ndarray, log_end: float):
    """Scores by the known grams, the base of the frequent words and the end, and the other words and grams with their counts."""

    def score(batches):
        for block in blocks(batches, BLOCK):
            words, counts = split_words(block["text"], lower=True)
            code_length, size, (text, grams, times) = tree.score(words, counts)
            codes, dictionary = word_codes(words)
            hashes = hash_words(dictionary)
            value, frequent = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
            if len(words_known):
                at = np.minimum(np.searchsorted(words_known, hashes), len(words_known) - 1)
                frequent = words_known[at] == hashes
                value = np.where(frequent, log_known[at], 0.0)
            owner = np.repeat(np.arange(len(counts)), counts)
            far = ~frequent[codes]
            pairs, n = np.unique((owner[far] << 32) | codes[far], return_counts=True)
            known = per_text(frequent[codes].astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    block["row"], block["doc_id"], block["held_out"], pa.array(counts + 1), pa.array(known),
                    pa.array(per_text(value[codes], counts) + log_end), pa.array(code_length * np.log10(2)),
                    pa.array(size.astype(np.int64)),
                    *_lists(pairs >> 32, len(counts), pa.array(signed(hashes[pairs & 0xFFFFFFFF])), pa.array(n.astype(np.int32))),
                    *_lists(text, len(counts), pa.array(signed(grams)), pa.array(times.astype(np.int32))),
                ],
                names=[part.split()[0] for part in SCORED.split(", ")],
            )

    return score


def score(documents: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` of every document."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out"))
    training = texts.filter(~F.col("held_out")).select("text")
    ends = training.count()
    counted = cut_lineage(mapped(training, _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sums = counted.agg(F.sum("n"), F.count(F.lit(1))).head()
    tokens, vocabulary = (sums[0] or 0) + ends, sums[1] + bool(ends)
    frequent = counted.filter(F.col("n") * FREQUENT >= tokens).toArrow()
    words = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    log_known = np.log10(frequent["n"].to_numpy()[order] + SMOOTHING)
    tree = predictions(texts, depth)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    scored = cut_lineage(
        mapped(rows, _scored(known(tree, depth), words[order], log_known, float(np.log10(ends + SMOOTHING))), SCORED)
    )
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("_pair"))
    pairs = pairs.select("row", F.col("_pair.rare").alias("word"), F.col("_pair.rare_n").alias("times"))
    met = pairs.join(counted, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    others = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + SMOOTHING)).alias("_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
    )
    places = scored.select("row", F.explode(F.arrays_zip("far", "far_n")).alias("_place"))
    places = places.select("row", F.col("_place.far").alias("gram"), F.col("_place.far_n").alias("times"))
    places = places.join(tree.select("gram", "log2"), "gram")
    others_log2 = places.groupBy("row").agg(F.sum(F.col("times") * F.col("log2").cast("double")).alias("_log2"))
    whole = float(np.log10(tokens + SMOOTHING * (vocabulary + 1)))
    known_end = F.lit(int(ends > 0))
    return scored.join(others, "row", "left").join(others_log2, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0)) + known_end).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.coalesce("_log2", F.lit(0.0)) * float(np.log10(2))).alias("score"), "n_bytes",
    )

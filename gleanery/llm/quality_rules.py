"""Distribution divergence: documents against the histograms of their language.

Two passes over all documents that pass the guards gather, for each language, the words
that hold at least ``COMMON_SHARE`` of its words with their exact counts, and the counts of
character classes. Equal texts of a language weigh as one, however many copies there are.
A document's two histograms are then compared with those of its language by
Jensen-Shannon distance (base 2, so 0 to 1). Texts with few words, whose histograms say
little, are judged by the guards alone.

Defined cases: a null text has no words and fails; a null language is a language of its
own, and so is the empty string; a language without a reference has only its character
classes compared, with those of all languages together, letters of any script in one class;
empty tables give empty results; repeated documents are judged each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach_small, blocks, in_pieces, mapped, split_words
from gleanery.llm.text_stats import CLASSES, class_counts, per_text, quality_counts, repeated_word_mask, word_codes
from gleanery.session import cut_lineage

#: A word is common in a language if it makes up this share of the language's words.
COMMON_SHARE = 0.002
#: A document is refused beyond these distances; a text of n words is allowed slack / sqrt(n) more,
#: as the histogram of a short text strays further from its source by chance.
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.22, 0.9
MAX_WORD_DISTANCE, WORD_SLACK = 0.25, 1.25
#: Words below which a document fails, and its histograms are not compared.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words of a language below which it has no reference of its own.
MIN_REFERENCE_WORDS = 10_000
#: Key of all languages together; names of languages are strings or null.
MIXTURE = 0

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)
COUNTED = "lang string, word string, class string, n double"


@dataclass(frozen=True)
class Reference:
    """A language's common words with their shares (all other words last), and its class shares.

    The ``mixed`` reference of all languages has no words, and its classes are those of ``_any_script``.
    """

    words: list[str]
    shares: np.ndarray
    classes: np.ndarray
    mixed: bool = False


def _any_script(classes: np.ndarray) -> np.ndarray:
    """Counts of classes with small letters and characters beyond ASCII together, as scripts differ in these."""
    lower, beyond = CLASSES.index("lower"), CLASSES.index("beyond_ascii")
    out = np.delete(classes, beyond, axis=-1)
    out[..., lower] += classes[..., beyond]
    return out


def _by_language(block: pa.RecordBatch):
    """Texts and weights of each language in a block; the name of a missing language is null."""
    encoded = block["lang"].dictionary_encode(null_encoding="encode")
    codes, names = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    for code, name in enumerate(names):
        rows = pa.array(np.flatnonzero(codes == code))
        yield name, block["text"].take(rows), block["weight"].take(rows).to_numpy()


def _base_failed(n: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def _weighed(texts: pa.Array, weights: np.ndarray, guarded: bool):
    """The words of the texts as codes with their weights, their dictionary, and the weight of each text."""
    words, counts = split_words(texts)
    codes, dictionary = word_codes(words)
    if guarded:
        repeats = per_text(repeated_word_mask(codes, counts).astype(np.int64), counts)
        weights = np.where(_base_failed(counts, repeats), 0.0, weights)
    return codes, np.repeat(weights, counts), dictionary, weights


def _counted(language, words=(), classes=(), counts=()) -> pa.RecordBatch:
    names = [*words, *([None] * len(classes))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([language] * len(names), pa.string()),
            pa.array(names, pa.string()),
            pa.array([*([None] * len(words)), *classes], pa.string()),
            pa.array(counts, pa.float64()),
        ],
        names=["lang", "word", "class", "n"],
    )


def _often(guarded: bool):
    """Words with half the share in a block, and the block's number of words (as class ``words``)."""

    def gather(batches):
        for block in blocks(batches):
            for language, texts, weights in _by_language(block):
                codes, weight, dictionary, _ = _weighed(texts, weights, guarded)
                count, total = np.bincount(codes, weight, len(dictionary)), float(weight.sum())
                rows = np.flatnonzero((count > 0) & (count * 2 >= COMMON_SHARE * total))
                words = dictionary.take(pa.array(rows)).to_pylist()
                yield _counted(language, words, ["words"], [*count[rows].tolist(), total])

    return gather


def _exact(candidates: dict[str | None, list[str]], guarded: bool):
    """Counts of the candidate words of each language, and of character classes."""

    def gather(batches):
        for block in blocks(batches):
            for language, texts, weights in _by_language(block):
                codes, weight, dictionary, weights = _weighed(texts, weights, guarded)
                count = np.bincount(codes, weight, len(dictionary) + 1)
                wanted = pa.array(candidates.get(language, []), dictionary.type)
                at = pc.index_in(wanted, dictionary).fill_null(len(dictionary)).to_numpy()
                classes = (class_counts(texts) * weights[:, None]).sum(axis=0).tolist()
                yield _counted(
                    language, wanted.to_pylist(), ["words", *CLASSES],
                    [*count[at].tolist(), float(weight.sum()), *classes],
                )

    return gather


def _summed(documents: DataFrame, gather) -> DataFrame:
    rows = mapped(documents.select("lang", "text", "weight"), gather, COUNTED)
    # Rounded, so that the order of the sums does not show.
    return rows.groupBy("lang", "word", "class").agg(F.round(F.sum("n"), 6).alias("n"))


def _once(documents: DataFrame) -> DataFrame:
    """``lang``, ``text`` and ``weight``: copies of one text in one language share the weight of one.

    Only hashes are shuffled, and those of texts with copies are joined back.
    """
    rows = documents.filter(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("lang", "text").alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    met = attach_small(rows, cut_lineage(copies), ["key"], "left")
    return met.select("lang", "text", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))


def sound_references(documents: DataFrame) -> dict[str | int | None, Reference]:
    """``references`` of the documents that pass the guards, each text once."""
    return _references(_once(documents), True)


def references(documents: DataFrame) -> dict[str | None, Reference]:
    """Over all rows as they are, with all languages together under ``""``; documents are not judged by these."""
    known = _references(documents.select("lang", "text", F.lit(1.0).alias("weight")), False)
    return {"" if k == MIXTURE else k: v for k, v in known.items()}


def _references(rows: DataFrame, guarded: bool) -> dict[str | int | None, Reference]:
    """The reference of each language with enough words, and under ``MIXTURE`` of all together.

    A word that holds the share over all has at least half of its count in blocks where it holds half the share,
    so at most ``2 / COMMON_SHARE`` words a language come back from the first pass.
    """
    first = _summed(rows, _often(guarded))
    totals = first.filter(F.col("class") == "words").select(F.col("lang").alias("_lang"), F.col("n").alias("_all"))
    found = first.filter(F.col("word").isNotNull()).join(totals, F.col("lang").eqNullSafe(F.col("_lang")))
    found = found.filter(F.col("n") * 2 >= COMMON_SHARE * F.col("_all"))
    candidates: dict[str | None, list[str]] = {}
    for row in found.select("lang", "word").collect():
        candidates.setdefault(row["lang"], []).append(row["word"])
    words: dict[str | None, dict[str, float]] = {}
    classes: dict[str | int | None, dict[str, float]] = {}
    for row in _summed(rows, _exact(candidates, guarded)).collect():
        if row["word"] is not None:
            words.setdefault(row["lang"], {})[row["word"]] = row["n"]
            continue
        for language in (row["lang"], MIXTURE):
            held = classes.setdefault(language, {})
            held[row["class"]] = held.get(row["class"], 0) + row["n"]
    out: dict[str | int | None, Reference] = {}
    for language, counts in classes.items():
        total = counts.pop("words")
        by_class = np.array([counts.get(c, 0) for c in CLASSES], float)
        by_class /= max(1.0, by_class.sum())
        if language == MIXTURE:
            out[MIXTURE] = Reference([], np.ones(1), _any_script(by_class), True)
        if language == MIXTURE or total < MIN_REFERENCE_WORDS:
            continue
        common = {w: n for w, n in sorted(words.get(language, {}).items()) if n >= COMMON_SHARE * total}
        rest = max(0, total - sum(common.values()))
        shares = np.array([*common.values(), rest], float) / max(1, total)
        out[language] = Reference(list(common), shares, by_class)
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one distribution; 0 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        two = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((one + two) / 2, 0, 1)), 0.0)


def _judged(texts: pa.Array, reference: Reference | None) -> dict[str, np.ndarray]:
    found = quality_counts(texts)
    n, repeats = found["n_words"], found["n_repeat_words"]
    found["base_failed"] = _base_failed(n, repeats)
    by_class, by_word = np.zeros(len(n)), np.zeros(len(n))
    if reference is not None:
        classes = _any_script(found["classes"]) if reference.mixed else found["classes"]
        by_class = distance(classes, reference.classes)
        place = np.full(len(found["dictionary"]) + 1, len(reference.words), np.int64)
        wanted = pa.array(reference.words, found["dictionary"].type)
        at = pc.index_in(wanted, found["dictionary"]).fill_null(len(found["dictionary"])).to_numpy()
        place[at] = np.arange(len(reference.words))
        place[-1] = len(reference.words)
        width = len(reference.words) + 1
        owner = np.repeat(np.arange(len(n)), n)
        cells = np.bincount(owner * width + place[found["codes"]], minlength=len(n) * width)
        by_word = distance(cells.reshape(len(n), width).astype(float), reference.shares)
    chance = 1 / np.sqrt(np.maximum(n, 1))
    far = (by_class > MAX_CLASS_DISTANCE + CLASS_SLACK * chance) | (by_word > MAX_WORD_DISTANCE + WORD_SLACK * chance)
    far &= n >= MIN_WORDS
    return found | {"class_distance": by_class, "word_distance": by_word, "kept": ~(found["base_failed"] | far)}


def judge(text: Column, lang: Column, known: dict[str | int | None, Reference]) -> Column:
    """A struct of ``FIELDS`` for each document."""
    names = [part.split()[0] for part in FIELDS.split(", ")]

    def fields(texts: pa.Array, languages: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts, languages], names=["text", "lang"])
        encoded = rows["lang"].dictionary_encode(null_encoding="encode")
        codes = encoded.indices.to_numpy()
        out: dict[str, np.ndarray] = {}
        for code, name in enumerate(encoded.dictionary.to_pylist()):
            at = np.flatnonzero(codes == code)
            found = _judged(texts.take(pa.array(at)), known.get(name, known.get(MIXTURE)))
            for field in names:
                out.setdefault(field, np.zeros(len(texts), found[field].dtype))[at] = found[field]
        empty = np.zeros(0, bool)
        return pa.StructArray.from_arrays([pa.array(out.get(f, empty)) for f in names], names=names)

    @F.arrow_udf(FIELDS)
    def judged(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return in_pieces(fields, texts, languages)

    return judged(text, lang)


def quality(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of ``judge`` for every document."""
    found = judge(F.col("text"), F.col("lang"), sound_references(documents))
    return documents.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


def keep(documents: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    verdict = judge(F.col("text"), F.col("lang"), sound_references(documents))
    return documents.filter(verdict["kept"])

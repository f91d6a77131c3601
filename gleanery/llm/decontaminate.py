"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Documents are cut into overlapping passages of twice the longest item, so any item lies whole
in one of them. Scores are shares of the item's score against itself, so one threshold
serves all items. The index keeps, for each item, its essential terms: the others together cannot
reach ``PIVOT`` of the threshold. Items stand in blocks, and a term's posting holds the highest score that
it gives in a block (block-max); a passage whose essential terms cannot lift a block over what its
items still need skips the whole block. Items of the blocks that remain are scored exactly, all passages above the
threshold are retrieved, and a hit stands if the passage holds enough of the item's question
and answer, by runs of words.

An item's last sentence is its answer and what stands before it the question; where one of them
has fewer than ``MIN_WORDS`` words, the whole item is both. Words are lower-cased, without the punctuation around them.

Defined cases: null and empty documents and items match nothing, as do items of fewer than ``MIN_WORDS`` words; an
empty benchmark gives no hits; ties are all returned; repeated documents and items
each give their own rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, hash_words, in_pieces, mapped, rolling, spans, split_words
from gleanery.llm.text_stats import word_codes
from gleanery.llm.token_ids import gathered

K1, B = 1.2, 0.75
#: Least share of an item's own score.
THRESHOLD = 0.4
#: Share of the threshold that an item's other terms may reach together.
PIVOT = 0.6
BLOCK_ITEMS = 4
MIN_WORDS = 5
RUN = 3
#: A hit holds this much of the question, or less of it and this much of the answer.
QUESTION, SOME_QUESTION, ANSWER = 0.6, 0.3, 0.6
#: Items held in one index; more are searched in several passes over the documents.
INDEX_ITEMS = 50_000
TRIMMED = ".,;:!?\"'()[]{}*#$%&|<>-"
HITS = "doc_id long, item_id long, start long, score double, question double, answer double"


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, without punctuation, and words per text."""
    words, counts = split_words(texts, lower=True)
    if not len(words):
        return np.zeros(0, np.uint64), counts
    codes, dictionary = word_codes(words)
    bare = pc.utf8_trim(dictionary, TRIMMED)
    filled = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)[codes]
    owner = np.repeat(np.arange(len(counts)), counts)
    return hash_words(bare)[codes[filled]], np.bincount(owner[filled], minlength=len(counts)).astype(np.int64)


def _runs(hashes: np.ndarray) -> np.ndarray:
    return np.unique(rolling(hashes, RUN))


@dataclass(frozen=True)
class Item:
    item_id: int
    terms: np.ndarray
    impacts: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass(frozen=True)
class Index:
    """Essential terms (sorted hashes) with their blocks and the highest impact there, and each block's postings."""

    items: list[Item]
    terms: np.ndarray
    first: np.ndarray
    number: np.ndarray
    block: np.ndarray
    highest: np.ndarray
    item_first: np.ndarray
    item_number: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    item_needs: np.ndarray
    needs: np.ndarray
    stride: int


def build(rows: list[tuple[int, str]], threshold: float = THRESHOLD) -> Index | None:
    """The index of some items."""
    parts = []
    for item_id, text in rows:
        sentences = re.split(r"(?<=[.!?])\s+", (text or "").strip())
        question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text or "", text or "")
        hashes, counts = _hashed(pa.array([text or "", question, answer], pa.string()))
        ends = np.cumsum(counts)
        whole, asked, told = hashes[:ends[0]], hashes[ends[0]:ends[1]], hashes[ends[1]:]
        if min(len(asked), len(told)) < MIN_WORDS:
            asked = told = whole
        if len(whole) >= MIN_WORDS:
            parts.append((item_id, whole, _runs(asked), _runs(told)))
    if not parts:
        return None
    mean = np.mean([len(p[1]) for p in parts])
    distinct = [np.unique(p[1], return_counts=True) for p in parts]
    every, df = np.unique(np.concatenate([d[0] for d in distinct]), return_counts=True)
    idf = np.log(1 + (len(parts) - df + 0.5) / (df + 0.5))
    items, postings, needs = [], [], []
    for (item_id, whole, asked, told), (terms, tf) in zip(parts, distinct, strict=True):
        gain = idf[np.searchsorted(every, terms)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole) / mean))
        impact = gain / gain.sum()
        order = np.argsort(impact, kind="stable")
        kept = np.cumsum(impact[order]) > PIVOT * threshold
        needs.append(threshold - impact[order][~kept].sum())
        postings += [(t, len(items), i) for t, i in zip(terms[order][kept], impact[order][kept], strict=True)]
        items.append(Item(item_id, terms, impact, asked, told))
    table = np.array(postings, dtype=[("term", np.uint64), ("item", np.int64), ("impact", np.float64)])
    table.sort(order=["term", "item"])
    term, block = table["term"], table["item"] // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
    terms, begin, number = np.unique(term[first], return_index=True, return_counts=True)
    item_needs = np.array(needs)
    return Index(
        items, terms, begin, number, block[first], np.maximum.reduceat(table["impact"], first),
        first, np.diff(first, append=len(table)), table["item"], table["impact"],
        item_needs, np.minimum.reduceat(item_needs, np.arange(0, len(needs), BLOCK_ITEMS)), max(len(p[1]) for p in parts),
    )


def _summed(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells, their sums, and each row's place among them."""
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    place = np.empty(len(cells), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], np.add.reduceat(values[order], first), place


def _candidates(index: Index, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, item) where the essential terms give all that the item needs.

    First by the terms' highest scores in each block; only postings of blocks that pass are read.
    """
    none = (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    if not len(known):
        return none
    owner, place = spans(counts)
    owner, place, term = owner[known], place[known], at[known]
    passages = np.maximum(1, -(-counts // index.stride) - 1)
    base = np.cumsum(passages) - passages
    part = place // index.stride
    # Passages overlap by half: a word stands in two of them, but for the first and last half.
    one = base[owner] + np.minimum(part, passages[owner] - 1)
    two = base[owner] + np.maximum(part - 1, 0)
    pairs = np.sort(np.concatenate([one, two]) * len(index.terms) + np.concatenate([term, term]))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    number = index.number[term]
    posting = gathered(np.arange(len(index.block)), index.first[term], number)
    passage = np.repeat(passage, number)
    cells, reach, cell = _summed(passage * len(index.needs) + index.block[posting], index.highest[posting])
    passing = (reach >= index.needs[cells % len(index.needs)] - 1e-9)[cell]
    passage, posting = passage[passing], posting[passing]
    if not len(posting):
        return none
    number = index.item_number[posting]
    exact = gathered(np.arange(len(index.item)), index.item_first[posting], number)
    cells, reach, _ = _summed(np.repeat(passage, number) * len(index.items) + index.item[exact], index.impact[exact])
    passage, item = cells // len(index.items), cells % len(index.items)
    enough = reach >= index.item_needs[item] - 1e-9
    passage, item = passage[enough], item[enough]
    text = np.searchsorted(base, passage, side="right") - 1
    return text, passage - base[text], item


def _share(part: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(part, held).mean()) if len(part) else 0.0


def _searched(index: Index, threshold: float):
    def search(batches):
        for batch in blocks(batches):
            hashes, counts = _hashed(batch["text"])
            ends = np.cumsum(counts)
            out = {}
            for text, passage, i in zip(*(x.tolist() for x in _candidates(index, hashes, counts)), strict=True):
                begin, item = passage * index.stride, index.items[i]
                own = hashes[ends[text] - counts[text]:ends[text]][begin:begin + 2 * index.stride]
                score = float(item.impacts[np.isin(item.terms, own)].sum())
                if score < threshold:
                    continue
                held = _runs(own)
                asked, told = _share(item.question, held), _share(item.answer, held)
                if asked < QUESTION and not (asked >= SOME_QUESTION and told >= ANSWER):
                    continue
                if (text, i) not in out or score > out[text, i][3]:
                    out[text, i] = (batch["doc_id"][text].as_py(), item.item_id, begin, score, asked, told)
            columns = list(zip(*out.values(), strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[part.split()[0] for part in HITS.split(", ")],
            )

    return search


def indexes(benchmark: DataFrame, size: int = INDEX_ITEMS) -> list[Index]:
    """All items, at most ``size`` to an index."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    out, held = [], []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == size:
            out.append(build(held))
            held = []
    if held:
        out.append(build(held))
    return [index for index in out if index]


def hits(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``HITS``: each document and item it holds, with the first word of the best passage."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for index in indexes(benchmark):
        part = mapped(texts, _searched(index, threshold), HITS)
        found = part if found is None else found.unionByName(part)
    return texts.sparkSession.createDataFrame([], HITS) if found is None else found


def leaks(benchmark: DataFrame, threshold: float = THRESHOLD):
    """A column function: whether a text holds an item."""
    known = indexes(benchmark)

    def holding(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["doc_id", "text"])
        found = np.zeros(len(texts), bool)
        for index in known:
            for part in _searched(index, threshold)(iter([rows])):
                found[part["doc_id"].to_numpy()] = True
        return pa.array(found)

    @F.arrow_udf("boolean")
    def leaking(texts: pa.Array) -> pa.Array:
        return in_pieces(holding, texts)

    return leaking


def keep(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return documents.filter(~leaks(benchmark, threshold)(F.col("text")))

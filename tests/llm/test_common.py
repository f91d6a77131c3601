import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.common import blocks, free_name, hash_words, rolling, spans, split_words
from gleanery.llm.suffixes import merged
from gleanery.llm.text_stats import CLASSES, class_counts, quality_counts
from gleanery.llm.token_ids import gathered

TEXTS = st.lists(st.none() | st.text(alphabet="aB \n\t\x0b\x85 é|.", max_size=40), max_size=8)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_runs_without_ascii_space(texts):
    found, counts = split_words(pa.array(texts, pa.string()))
    assert found.to_pylist() == [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]


def test_words_of_a_slice():
    texts = pa.array(["first One", "SECOND two", None, "third"]).slice(1)
    assert split_words(texts, lower=True)[0].to_pylist() == ["second", "two", "third"]


def test_hashes_differ_and_do_not_depend_on_neighbours():
    some = [f"{a}{b}" for a in "abcdefghij" for b in range(3000)]
    hashes = hash_words(pa.array(some))
    assert len(set(hashes.tolist())) == len(some)
    assert hash_words(pa.array(some[7:9])).tolist() == hashes[7:9].tolist()
    assert len(hash_words(pa.array([], pa.string()))) == 0


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_rolling_hash_is_equal_for_equal_runs_only(values, width):
    found = rolling(np.array(values, np.uint64), width)
    runs = [tuple(values[i:i + width]) for i in range(len(values) - width + 1)]
    assert len(found) == len(runs)
    for i, one in enumerate(runs):
        for j, two in enumerate(runs):
            assert (found[i] == found[j]) == (one == two)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 9)), max_size=20))
@settings(max_examples=150, deadline=None)
def test_merged_intervals_cover_the_same_places(rows):
    owner, begin, size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    o, b, e = merged(owner, begin, begin + size)
    want = {(int(x), p) for x, a, n in rows for p in range(a, a + n)}
    assert {(int(x), p) for x, a, z in zip(o, b, e) for p in range(a, z)} == want
    assert all(not (o[i] == o[i + 1] and b[i + 1] <= e[i]) for i in range(len(o) - 1))


def test_spans_and_gathered():
    owner, place = spans(np.array([2, 0, 3]))
    assert owner.tolist() == [0, 0, 2, 2, 2] and place.tolist() == [0, 1, 0, 1, 2]
    assert gathered(np.arange(10), np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]


def test_blocks_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"text": [str(i)] * 3}) for i in range(20)]
    found = [t for b in blocks(iter(batches), 20) for t in b["text"].to_pylist()]
    assert found == [str(i) for i in range(20) for _ in range(3)]
    assert list(blocks(iter([]))) == []


def test_free_name(spark):
    assert free_name(spark.range(1).toDF("_Row"), "_row") == "_row_"


def brute_counts(text):
    text = text or ""
    own = words(text)
    windows = {}
    for i in range(len(own) - 7):
        windows.setdefault(tuple(own[i:i + 8]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@given(st.lists(st.none() | st.text(alphabet="ab#|é\U0001F600 \n", max_size=120), max_size=6))
@settings(max_examples=200, deadline=None)
def test_quality_counts(texts):
    found = quality_counts(pa.array(texts, pa.string()))
    got = list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute_counts(t) for t in texts]


def test_classes_count_characters():
    counts = class_counts(pa.array(["aB1 .#é\U0001F600~", None]))
    assert dict(zip(CLASSES, counts[0].tolist())) == {
        "lower": 1, "upper": 1, "digit": 1, "space": 1, "sentence": 1, "symbol": 1, "other": 1, "beyond_ascii": 2}
    assert counts[1].sum() == 0

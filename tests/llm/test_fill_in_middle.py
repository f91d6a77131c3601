import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import fill_in_middle as fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=fim.RATE):
    """n, form, prefix, middle and suffix of a text, token by token."""
    text = text or ""
    units = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    form = "psm" if h[3] % 100 >= fim.SUFFIX_FIRST else "spm"
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        form = "plain"
    return len(units), form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def expected(doc_id, text, rate=fim.RATE):
    n, form, prefix, middle, suffix = brute(doc_id, text, rate)
    output = {"plain": text or "", "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *chars, output)


@given(st.lists(st.integers(0, 7), max_size=400), st.lists(st.integers(0, 400), max_size=20))
def test_ranks_count_occurrences(symbols, places):
    matrix = fim.WaveletMatrix(np.array(symbols, np.uint8), 3)
    at = np.array([min(p, len(symbols)) for p in [*places, 0, len(symbols)]])
    for symbol in range(8):
        assert matrix.rank(symbol, at).tolist() == [symbols[:p].count(symbol) for p in at]


TEXT = st.text(alphabet="ab \t\n é\U0001F600<PSM>", max_size=40) | st.text(max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8), st.data())
def test_cuts_fall_after_tokens(texts, data):
    cutter = fim.Cutter(pa.array(texts, pa.string()))
    units = [TOKENS.findall(t) for t in texts]
    assert cutter.tokens.tolist() == [len(u) for u in units]
    wanted = np.array([data.draw(st.integers(0, len(u))) for u in units], np.int64)
    place = cutter.place(wanted)
    begin = cutter.borders[:-1]
    heads = ["".join(u[:k]) for u, k in zip(units, wanted)]
    assert (place - begin).tolist() == [len(h.encode()) for h in heads]
    assert cutter.characters(begin, place).tolist() == [len(h) for h in heads]


def test_awkward_rows_and_exact_restoring(spark, awkward):
    more = [(i, t) for i, t in enumerate(["<P>", "a <S> b", "<<M> x", "<", "<P <S <M", "a <", "< P> b <", " ", "é\u0085è", "x" * 9])] * 3
    rows = awkward.select("doc_id", "text", "score").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("score", F.lit("x")))
    for rate in (fim.RATE, 100):
        out = fim.rearrange(rows, rate=rate)
        found = [tuple(r) for r in out.collect()]
        want = [expected(r.doc_id, r.text, rate) for r in rows.collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
        back = out.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text")).collect()
        assert sorted(map(str, back)) == sorted(str(r) for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())


def test_empty_table(nothing):
    assert fim.rearrange(nothing).count() == 0
    assert [f.name for f in fim.rearrange(nothing).schema] == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import packing, repair
from gleanery.llm.queries import tokenizer_path
from gleanery.llm.token_ids import TokenIds

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def tokens():
    return TokenIds(PATH)


def test_ids_of_every_character_before_a_stop():
    """All code points but surrogates, unassigned planes and private use, and both stops."""
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xF900]
    for stop in ".,":
        texts = [f"{c}{stop} a{c}{stop}" for c in points]
        found = TokenIds.shared(PATH)
        for begin in range(0, len(texts), 20_000):
            some = texts[begin:begin + 20_000]
            ids, counts = found.encode(pa.array(some, pa.string()))
            want = [[*e.ids, 2] for e in found._tokenizer.encode_batch(some, add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


@given(st.lists(st.none() | st.text(max_size=30) | st.text(alphabet="aAb.,'s <|>\ńéİ", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizers(texts):
    ids, counts = TokenIds.shared(PATH).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [ids[e - c:e].tolist() for e, c in zip(ends, counts)] == [ids_of(t) for t in texts]


def test_special_tokens_keep_their_meaning(tokens):
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>x", "The, end.", "THE. the,the 3. 中."]
    ids, counts = tokens.encode(pa.array(texts))
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == ids_of(texts[0])
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("gleanery.llm.token_ids.KNOWN_WORDS", 3)
    small = TokenIds(PATH)
    for text in ("one two three four", "five one six", "one"):
        assert small.encode(pa.array([text]))[0].tolist() == ids_of(text)


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=80), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_grammar_round_trip(documents):
    repair_min, repair.MIN_PAIR = repair.MIN_PAIR, 2
    try:
        counts = np.array([len(d) for d in documents])
        ids = np.array([i for d in documents for i in d], "<u2")
        shard = repair.Shard(repair.container(pa.array(range(len(counts)), pa.int64()), ids, counts, 49408))
    finally:
        repair.MIN_PAIR = repair_min
    assert shard.all_ids().tolist() == ids.tolist()
    for i, d in enumerate(documents):
        assert shard.ids(i).tolist() == d
        assert shard.ids(i, 2, 5).tolist() == d[2:5]
        assert shard.ids(i, len(d)).tolist() == []


def test_frequent_pairs_shrink_a_shard():
    ids = np.tile(np.arange(16, dtype="<u2"), 500)
    data = repair.container(pa.array([None], pa.int64()), ids, np.array([len(ids)]), 49408)
    shard = repair.Shard(data)
    assert len(shard.rules) >= 8 and len(shard.symbols) < len(ids) / 8 and shard.doc_ids.to_pylist() == [None]
    with pytest.raises(ValueError):
        repair.Shard(b"XXXX" + data[4:])


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_written_files_hold_all_documents_in_order(spark, awkward, tmp_path, shard_ids):
    repair.write(awkward, str(tmp_path / "out"), PATH, shard_ids=shard_ids)
    got = repair.read(spark.read.parquet(str(tmp_path / "out"))).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(got, rows, strict=True):
        ids = ids_of(text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)


def test_empty_table_writes_no_shard(spark, nothing, tmp_path):
    repair.write(nothing, str(tmp_path / "out"), PATH)
    assert repair.read(spark.read.schema(repair.SHARDS).parquet(str(tmp_path / "out"))).count() == 0
    assert packing.pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("length", [16, 4096])
def test_packing_cuts_every_id_once(awkward, length):
    got = packing.pack(awkward, PATH, length).orderBy("sequence_id", "offset").collect()
    want = sorted(tuple(ids_of(r.text)) for r in awkward.collect())
    at, stream = 0, []
    for r in got:
        assert r.sequence_id * length + r.offset == at and 0 < r.length <= length - r.offset
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        stream += ids
        at += r.length
    documents, begin = [], 0
    for i, token in enumerate(stream):
        if token == 2:
            documents.append(tuple(stream[begin:i + 1]))
            begin = i + 1
    assert sorted(documents) == want
    assert sum(r.doc_tokens for r in got if r.start == 0) == len(stream)


def test_padding(spark, awkward):
    sizes = packing.padded_sizes(packing.pack(awkward, PATH, 64), 64).orderBy("sequence_id").collect()
    assert all(r.tokens == 64 == r.padded for r in sizes[:-1])
    assert sizes[-1].padded in (64, sizes[-1].tokens)
    pieces = spark.createDataFrame([(0, 8), (1, 7)], "sequence_id long, length long")
    assert [r.padded for r in packing.padded_sizes(pieces, 64).orderBy("sequence_id").collect()] == [8, 64]

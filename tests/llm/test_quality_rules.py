import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import quality_rules

from .conftest import DOCUMENTS, prose
from .test_common import brute_counts


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = np.sqrt(sum(x * np.log2(x / y) for x, y in zip(p, m) if x) / 2 + sum(x * np.log2(x / y) for x, y in zip(q, m) if x) / 2)
    got = quality_rules.distance(np.array([[2.0, 2.0, 0.0], [0, 0, 0]]), q)
    assert np.allclose(got, [want, 0])
    assert np.allclose(quality_rules.distance(np.array([[1.0, 1.0, 2.0]]), q), 0)


def test_counts_and_guards_of_awkward_rows(awkward):
    rows = quality_rules.quality(awkward).join(awkward.select("doc_id", "text"), "doc_id").collect()
    assert quality_rules.quality(awkward).count() == awkward.count()
    for r in quality_rules.quality(awkward.filter("doc_id > 2")).join(awkward.select("doc_id", "text"), "doc_id").collect():
        n, *rest = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r.kept and r.base_failed)
    assert rows


def test_strange_texts_are_refused_and_plain_ones_kept(spark):
    plain = [(i, prose(i, 150) + ". The the of and the.", "en", "s", 0) for i in range(100)]
    odd = [(1000, " ".join(f"{w}$$$" for w in prose(7, 120).split()), "en", "s", 0), (1001, prose(8, 120).upper(), "en", "s", 0),
           (1002, "1 2 3 4 5 6 7 8 9 0 " * 2 + " ".join(str(i * 7919) for i in range(150)), None, "s", 0)]
    found = {r.doc_id: r.kept for r in quality_rules.quality(spark.createDataFrame(plain + odd, DOCUMENTS)).collect()}
    assert all(found[i] for i in range(100))
    assert not any(found[i] for i in (1000, 1001, 1002))


def test_keep_returns_all_columns(awkward, nothing):
    kept = quality_rules.keep(awkward)
    assert kept.columns == awkward.columns and kept.filter(F.col("text").isNull()).count() == 0
    assert quality_rules.keep(nothing).count() == 0 and quality_rules.quality(nothing).count() == 0


def test_references_hold_exact_counts(spark):
    rows = [(i, ("alpha " * 30 + prose(i, 70)) if i % 2 else "beta " * 100, "xx", "s", 0) for i in range(200)]
    known = quality_rules.references(spark.createDataFrame(rows, DOCUMENTS).repartition(5))
    share = dict(zip(known["xx"].words, known["xx"].shares))
    assert abs(share["alpha"] - 0.15) < 1e-12 and abs(share["beta"] - 0.5) < 1e-12
    assert abs(known["xx"].shares.sum() - 1) < 1e-12 and set(known) == {"xx", ""}


def test_copies_of_junk_do_not_become_the_reference(spark):
    common = "the of and to in is was for that with".split()
    mixed_in = lambda i, n: " ".join(w if k % 3 else f"{w} {common[(i + k) % 10]}" for k, w in enumerate(prose(i, n).split()))
    clean = [(i, mixed_in(i, 150), "en", "s", 0) for i in range(200)]
    repetitive = [(1000 + i, "buy cheap pills now at our big store today " * 30, "en", "s", 0) for i in range(100)]
    one_text = [(2000 + i, " ".join(f"zz{k}" for k in range(200)), "en", "s", 0) for i in range(100)]
    for junk in (repetitive, one_text):
        rows = spark.createDataFrame(clean + junk, DOCUMENTS).repartition(4)
        kept = {r.doc_id: r.kept for r in quality_rules.quality(rows).collect()}
        assert sum(kept[i] for i in range(200)) == 200
    alone, beside = (quality_rules.sound_references(spark.createDataFrame(r, DOCUMENTS))["en"] for r in (clean, clean + repetitive))
    assert alone.words == beside.words and np.allclose(alone.shares, beside.shares)


def test_rare_languages_are_not_judged_by_words_of_others(spark):
    common = "the of and to in is was for that with".split()
    often = [(i, " ".join(f"{w} {common[(i + k) % 10]}" for k, w in enumerate(prose(i, 150).split())), "en", "s", 0) for i in range(200)]
    cyrillic = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхуз")
    rare = [(1000 + i, prose(1000 + i, 150), "xx", "s", 0) for i in range(20)]
    rare += [(1100 + i, prose(1100 + i, 150).translate(cyrillic), "ru", "s", 0) for i in range(20)]
    unnamed = [(1200 + i, prose(1200 + i, 150), "", "s", 0) for i in range(100)]
    odd = [(2000, " ".join(str(i * 7919) for i in range(150)), "xx", "s", 0), (2001, prose(7, 150).upper(), "ru", "s", 0)]
    rows = spark.createDataFrame(often + rare + unnamed + odd, DOCUMENTS).repartition(4)
    known = quality_rules.sound_references(rows)
    assert set(known) == {"en", "", quality_rules.MIXTURE}
    alone = quality_rules.sound_references(spark.createDataFrame(unnamed, DOCUMENTS))[""]
    assert known[""].words == alone.words and np.allclose(known[""].shares, alone.shares)
    found = {r.doc_id: r.kept for r in quality_rules.quality(rows).collect()}
    assert {i for i, kept in found.items() if not kept} == {2000, 2001}

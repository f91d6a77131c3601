import random
import re

import pytest

from gleanery.llm import common, license_scan
from tests.llm.conftest import DOCUMENTS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, phrases, notices):
    """Spans by trying every k-gram at every place of every template."""
    w, places, base, labels, score = words(text), [], set(), set(), 0.0
    for group, exact in ((phrases, True), (notices, False)):
        for label, template in group:
            t = template.split()
            k = min(license_scan.WIDTH, len(t))
            votes = {}
            for p in range(len(w) - k + 1):
                for q in range(len(t) - k + 1):
                    if w[p:p + k] == t[q:q + k]:
                        votes.setdefault(p - q, []).append((p, q))
            spans, last = [], None
            for d in sorted(votes):
                if last is None or d - last > (0 if exact else license_scan.DRIFT):
                    spans.append([])
                spans[-1] += votes[d]
                last = d
            for span in spans:
                found = len({q + i for _, q in span for i in range(k)})
                begin, end = min(p for p, _ in span), max(p for p, _ in span) + k
                score = max(score, found / len(t))
                if exact and found == len(t):
                    places.append(begin)
                    base.add(label)
                elif not exact and 100 * found >= license_scan.SHARE * len(t) and end - begin <= license_scan.STRETCH * len(t):
                    labels.add(label)
    return (
        len(w), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
    )


def texts():
    draw, out = random.Random(7), []
    notices = [t for _, t in license_scan.NOTICES]
    for i in range(60):
        t = draw.choice(notices).split()
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(t))
            change = draw.randint(0, 2)
            t[at:at + (change > 0)] = [] if change == 1 else [draw.choice(["word", "cc", "license", "the"])]
        out.append(prose(i, 12) + draw.choice([" ", "\n# ", ", "]).join(["", *t, ""]) + prose(i + 99, 5))
    return out + [
        "CC-BY cc by CC  BY, cc\nby", "cc by " * 50, "General Public License", "general public licenses", "All rights reserved.", "all rights all rights reserved",
        "ccby", "écc by", "cc byK", "Released under the KMIT license", "Released under the MIT licence and the MIT License.", "cc", "by cc",
        "general public license all rights reserved general public license", None, "", "\0", "the " * 400,
    ]


@pytest.mark.parametrize("small", [True, False])
def test_every_place_is_found(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rows = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts())], "doc_id long, text string, label string, k string")
    found = license_scan.scan(rows.repartition(5), license_scan.templates(spark)).collect()
    assert len(found) == rows.count()
    for r in found:
        want = brute(texts()[r.doc_id], license_scan.PHRASES, license_scan.NOTICES)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:-1], texts()[r.doc_id]
        assert r.score == pytest.approx(want[-1])


def test_notices_survive_changes_and_prose_has_none(spark):
    notice = dict((label, text) for label, text in license_scan.NOTICES)["bsd"].split()
    changed = [*notice[:6], "forms", *notice[6:11], *notice[12:], "end"]
    rows = spark.createDataFrame([(1, prose(1, 50) + " ".join(["", *changed]), None, None, 1), (2, prose(2, 400), None, None, 1)], DOCUMENTS)
    found = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan(rows, license_scan.templates(spark)).collect()}
    assert found == {1: ("bsd", ""), 2: ("", "")}


def test_awkward_rows_and_empty_tables(spark, awkward, nothing):
    known = license_scan.templates(spark)
    found = license_scan.scan(awkward, known).collect()
    assert sorted(((r.doc_id, r.n_words) for r in found), key=str) == sorted(((r.doc_id, len(words(r.text))) for r in awkward.collect()), key=str)
    assert all((r.n_base, r.first_word, r.labels) == (0, None, "") for r in found)
    assert license_scan.scan(nothing, known).count() == 0
    assert {(r.labels, r.score) for r in license_scan.scan(awkward, known.limit(0)).collect()} == {("", 0.0)}


def test_only_the_kelvin_sign_folds_to_a_letter(spark):
    points = [i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(chr(i),) for i in points[:70_000]], "text string")
    folded = rows.select(license_scan.words_of(rows.text).alias("w")).collect()
    assert all(len(r.w) == 1 and not re.search("[a-z]", r.w[0].replace("i̇", "")) for r in folded)

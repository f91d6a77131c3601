import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleanery.functions import dates, enums, keys, phrases, records, templates, urls
from gleanery.operators.cardinality import bounds, constrain, one
from gleanery.operators.fields import delist, enlist


@pytest.mark.parametrize(
    "template, text, expected",
    [
        ("{value}. {}", "Title. rest", "Title"),
        ("{} Volume {value}, {}", "J volume 12, x", "12"),
        ("{value}", "multi\nline", "multi\nline"),
        ("a{value}", "a", None),
        ("({value})", "(x.y)", "x.y"),
        ("{}", "anything", None),
        ("{value}-{value}", "ab-ab", "ab"),
    ],
)
def test_capture_templates(value, template, text, expected):
    assert value(templates.parse_templates(F.lit(text), [template])) == expected


def test_first_matching_template_decides(value):
    parse = lambda *t: value(templates.parse_templates(F.lit("a-b"), list(t)))
    assert parse("x{value}", "{value}-{}", "{}-{value}") == "a"
    assert parse("{}-{}", "{value}-b") is None


def test_parsing_a_list_drops_misses(value):
    texts = F.array(F.lit("a1"), F.lit("b2"), F.lit(""), F.lit(None))
    assert value(templates.parse_values(texts, ["a{value}"])) == ["1", "", None]


def test_references(value):
    row = {"who": F.lit("Ann"), "trip": F.struct(F.lit(12).alias("days")), "none": F.lit(None)}
    resolve = lambda name: F.col(name)
    render = lambda t: value(templates.render_references(t, resolve), **row)
    assert render("<who> left for <trip.days> days") == "Ann left for 12 days"
    assert render("[<none>]") == "[]" and render("plain") == "plain"


@pytest.mark.parametrize(
    "text, base, expected",
    [
        ("https://u:p@h.org:81/x?q", None, "u:p@h.org:81"),
        ("//h.org/x", None, "h.org"),
        ("h.org/x", None, "h.org"),
        ("h.org", None, "h.org"),
        ("/x/y", "http://b.org/z", "b.org"),
        ("/x/y", "b.org", "b.org"),
        ("/x/y", "/z", None),
        ("/x/y", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_domains(value, text, base, expected):
    url = F.lit(text).cast("string")
    base_url = None if base is None else F.lit(base)
    assert value(urls.derive_domain(url, base_url)) == expected
    if expected is None:
        with pytest.raises(PySparkException):
            value(urls.derive_domain(url, base_url, strict=True))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("https://www.h.org/a/", "h.org/a"),
        ("http://h.org/a//?q=/", "h.org/a/"),
        ("h.org/www.x", "h.org/www.x"),
        ("https://h.org/a#f?q", "h.org/a#f"),
    ],
)
def test_clip(value, text, expected):
    assert value(urls.clip_url(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("HTTP://U@H.org:80", "http://U@h.org/"),
        ("https://h.org:8443/a/../b/./c?x=/../y#Z", "https://h.org:8443/b/c?x=/../y#Z"),
        ("h.org/x", "https://h.org/x"),
        ("https://h.org/a/..", "https://h.org/"),
        ("https://h.org/a/b/.", "https://h.org/a/b/"),
        ("", None),
        (None, None),
    ],
)
def test_normal_form(value, text, expected):
    assert value(urls.normalize_url(F.lit(text).cast("string"))) == expected


def test_hosts_beyond_ascii(spark):
    draw = random.Random(3)
    letters = "abcxyz0189-\u00fc\u00e9\u00df\u0131\u03b1\u0436\u05d0\u3042\u4f8b\u6f22\U0001f600\U00020000"
    labels = ["b\u00fccher", "\u4f8b\u3048", "\u0444\u044b\u0432\u0430", "\u00fc", "\u00fc" * 40, *[
        "".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(300)
    ]]
    rows = spark.createDataFrame([(v, f"www.{v}.org") for v in labels], "label string, host string")
    for label, host in rows.select("label", urls.ascii_host(F.col("host"))).collect():
        low = label.lower()
        expected = low if low.isascii() else "xn--" + low.encode("punycode").decode()
        assert host == f"www.{expected}.org"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("https://B\u00dcCHER.de/%7ea/%7Eb/~c", "https://xn--bcher-kva.de/~a/~b/~c"),
        ("https://xn--bcher-kva.de/~a/~b/~c", "https://xn--bcher-kva.de/~a/~b/~c"),
        ("https://b\u00fccher\u3002de:443", "https://xn--bcher-kva.de/"),
        ("https://h.org/a%2fb?q=%c3%a9%41#%zz", "https://h.org/a%2Fb?q=%C3%A9A#%25zz"),
        ("https://h.org/\u00e9 \U0001f600?a b=%", "https://h.org/%C3%A9%20%F0%9F%98%80?a%20b=%25"),
        ("https://h.org/x%2e/%2E%2e/y", "https://h.org/y"),
        ("https://h.org/%", "https://h.org/%25"),
        ("https://h.org/%25", "https://h.org/%25"),
    ],
)
def test_normal_form_beyond_ascii(value, text, expected):
    assert value(urls.normalize_url(F.lit(text))) == expected
    assert value(urls.normalize_url(F.lit(expected))) == expected


def test_links(value):
    page = F.lit("https://h.org/a/b?q=1")
    link = lambda t: value(urls.resolve_link(F.lit(t), page))
    assert link("/x") == "https://h.org/x" and link("y") == "https://h.org/a/y"
    assert link("//k.org/z") == "https://k.org/z" and link("ftp://f/") == "ftp://f/"


def test_quote(value):
    assert value(urls.url_quote(F.lit("a b/c*~+é&"))) == "a%20b/c%2A~%2B%C3%A9%26"


GOOD = {
    "2021": 1, "2021-02": 2, "2021-02-28": 3, "2021-02-28T23": 4, "2021-02-28T23:59": 5,
    "2021-02-28T23:59:58": 6, "2021-02-28T23:59:58.000007": 7, "7": 1, "77-8": 2, "777-8-9T1:2:3.4": 7,
}
BAD = [
    "", "0000", "0", "12345", "2021-0", "2021-13", "2021-02-29", "2021-02-", "2021-02-01T24",
    "2021-02-01T10:60", "2021-02-01T10:00:60", "2021-02-01T10:00:00.", "2021-02-01 ",
    "2021-02-01T10:00:00.1234567",
]


@pytest.mark.parametrize("text, code", GOOD.items())
def test_iso_prefixes(value, text, code):
    parsed = dates.deserialize_granular(F.lit(text))
    assert value(parsed)["granularity"] == code
    if len(text.split("-")[0]) == 4:
        assert value(dates.serialize_granular(parsed)) == text


@pytest.mark.parametrize("text", BAD)
def test_unreal_iso_prefixes(value, text):
    assert value(dates.deserialize_granular(F.lit(text))) is None


@pytest.mark.parametrize(
    "text, formats, expected",
    [
        ("1 August 2005", ["%d %B %Y", "%B %Y"], ("2005-08-01 00:00:00", 3)),
        ("AUGUST  2005", ["%d %B %Y", "%B %Y"], ("2005-08-01 00:00:00", 2)),
        ("Published online 2012 Feb 3.", ["Published online %Y %b %d."], ("2012-02-03 00:00:00", 3)),
        ("68 69", ["%y %H"], None),
        ("68 9", ["%y %H"], ("2068-01-01 09:00:00", 2)),
        ("10:11:12.5", ["%H:%M:%S.%f"], ("1900-01-01 10:11:12.500000", 4)),
        ("30 February 2001", ["%d %B %Y"], None),
        ("2005x", ["%Y"], None),
    ],
)
def test_strptime(value, text, formats, expected):
    parsed = value(dates.strptime(F.lit(text), formats))
    assert (parsed and (str(parsed["ts"]), parsed["granularity"])) == expected


def test_epochs(value):
    text = lambda c: str(value(c))
    assert text(dates.epoch_to_utc(F.lit(0))) == "1970-01-01 00:00:00"
    assert text(dates.epoch_to_utc(F.lit(1500000000))) == "2017-07-14 02:40:00"
    assert text(dates.epoch_to_utc(F.lit(1500000000000))) == "2017-07-14 02:40:00"
    assert text(dates.epoch_to_utc(F.lit(15), 100)) == "1970-01-01 00:25:00"
    assert text(dates.epoch_to_local(F.lit(0), "Asia/Tokyo")) == "1970-01-01 09:00:00"


# --- keys ----------------------------------------------------------------------


def build(value, qualifiers, fields, display):
    entries = [
        keys.key_field(n, F.array(*[F.lit(x) for x in v]), many=True)
        if isinstance(v, list) else keys.key_field(n, F.lit(v).cast("string"))
        for n, v in fields
    ]
    array = F.array(*entries) if entries else F.array().cast(f"array<{keys.FIELD_TYPE}>")
    quals = F.array(*[F.lit(q) for q in qualifiers]).cast("array<string>")
    return value(keys.build_key(quals, array, display))


KEY = (["content", "x"], [("url", "u"), ("geo", ["Texas", "TX"]), ("org", None), ("Δ", "δ")])


def test_key_forms(value):
    assert build(value, *KEY, True) == "content&x&url=u&geo=Texas|TX&org=~&Δ=δ"
    assert build(value, *KEY, False) == "content\1x\1url\2u\1geo\2Texas\3TX\1org\2\0\1Δ\2δ"


@pytest.mark.parametrize("display", [True, False])
def test_key_round_trip(value, display):
    parsed = value(keys.parse_key(F.lit(build(value, *KEY, display))))
    assert parsed["qualifiers"] == KEY[0]
    found = [(f["name"], f["values"]) for f in parsed["fields"]]
    assert found == [("url", ["u"]), ("geo", ["Texas", "TX"]), ("org", None), ("Δ", ["δ"])]


def test_key_errors(value):
    assert value(keys.parse_key(F.lit("a=1&b"))) is None
    with pytest.raises(PySparkException):
        value(keys.parse_key(F.lit("a=1&b"), strict=True))
    with pytest.raises(PySparkException):
        build(value, [], [], True)
    repeated = value(keys.parse_key(F.lit("q&a=1&b=2&a=3")))
    assert [(f["name"], f["values"]) for f in repeated["fields"]] == [("a", ["3"]), ("b", ["2"])]
    assert value(keys.parse_key(F.lit("only")))["qualifiers"] == ["only"]


# --- records -------------------------------------------------------------------


def test_record_round_trip(spark):
    row = spark.sql(
        "SELECT 'u' source_url, 3 rank, 'v1' _cache_version, timestamp_ntz'2020-01-02 03:04:05.000006' _last_extracted"
    )
    for name in records.ARTICLE.names():
        if name not in row.columns:
            kind = next(f for f in records.ARTICLE.fields if f.name == name)
            row = row.withColumn(name, F.lit(None).cast(kind.sql_type))
    row = row.withColumns(
        {"title": F.lit("T"), "issue_date": F.lit("2020-02-01").cast("timestamp_ntz"),
         "issue_date_granularity": F.lit(2).cast("tinyint")}
    )
    stored = row.select(records.to_hash(records.ARTICLE).alias("h"))
    hashed = stored.head()["h"]
    assert hashed["__model__"] == "ResearchArticle" and "volume" not in hashed
    assert hashed["_last_extracted"] == "2020-01-02T03:04:05.000006"
    assert hashed["issue_date_granularity"] == "Granularity.MONTH"
    back = stored.select(*records.from_hash(F.col("h"), records.ARTICLE))
    names = records.ARTICLE.names(private=True)
    assert back.select(names).collect() == row.select(names).collect()
    other = stored.select(*records.from_hash(F.col("h"), records.AGENT)).head()
    assert other["source_url"] is None


@pytest.mark.parametrize("charset", ["utf-8", "utf-16"])
def test_codecs(value, charset):
    hashed = F.create_map(F.lit("__model__"), F.lit("M"), F.lit("k"), F.lit("é"))
    coded = records.encode_hash(hashed, charset)
    assert value(records.decode_hash(coded, charset)) == {"__model__": "M", "k": "é"}
    wrong = {"utf-8": "utf-16", "utf-16": "utf-8"}[charset]
    with pytest.raises(PySparkException):
        value(records.decode_hash(coded, wrong))


def test_private_columns(spark):
    stored = spark.sql("SELECT 1 a, 2 _b")
    assert records.public_columns(stored).columns == ["a"]


# --- enumerations --------------------------------------------------------------

GRADE = enums.Enumeration.of("Grade", LOW=1, MID=2, TOP=3)
PLACE = enums.Enumeration.of("Place", increasing=False, GOLD=1, SILVER=2, BRONZE=3)


def test_casting(value):
    assert value(GRADE.cast(F.lit("mid"))) == 2 and value(GRADE.member(F.lit(3))) == 3
    assert value(GRADE.cast(F.lit(None).cast("string"), nullable=True)) is None
    for bad in (F.lit("none"), F.lit(None).cast("string")):
        with pytest.raises(PySparkException):
            value(GRADE.cast(bad))
    assert value(GRADE.from_qualified(F.lit("a.b.Grade.TOP"))) == 3


def test_pairs():
    assert GRADE.pairs()[0] == ("LOW", 1) and GRADE.pairs(swap=True)[0] == (1, "LOW")
    assert GRADE.pairs(labels=True, transform=str.lower, inverse=True)[0] == ("LOW", "low")


def test_extremes(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("b", 2)], "k string, c int")
    best = {r["k"]: (r["g"], r["p"]) for r in rows.groupBy("k").agg(
        GRADE.maximum(F.col("c")).alias("g"), PLACE.maximum(F.col("c")).alias("p")).collect()}
    assert best == {"a": (3, 1), "b": (2, 2)}
    with pytest.raises(PySparkException):
        rows.agg(GRADE.minimum(F.col("c"), nullable=False)).collect()
    assert rows.filter("false").agg(GRADE.minimum(F.col("c")).alias("m")).head()["m"] is None
    merged = GRADE.consolidate(rows, ["k"], "c", lambda a, b: F.greatest(a, b))
    assert {r["k"]: r["c"] for r in merged.collect()} == {"a": 3, "b": 2}


@pytest.mark.parametrize("times", [1, 2, 3, 4, 7, 100])
def test_merging_counts_repetitions(spark, times):
    total = enums.Enumeration.of("Total", **{f"N{i}": i for i in range(1, 401)})
    rows = spark.range(times).select(F.lit(2).alias("c"), F.lit(0).alias("k"))
    rows = rows.unionByName(rows.withColumn("c", F.lit(1)).limit(1))
    summed = total.consolidate(rows, ["k"], "c", lambda a, b: a + b)
    assert summed.head()["c"] == 2 * times + 1
    with pytest.raises(PySparkException):
        GRADE.consolidate(rows, ["k"], "c", lambda a, b: a + b + 5).collect()


def test_lists(value):
    assert value(enlist(F.lit("a"))) == ["a"] and value(enlist(F.lit(None).cast("string"))) == []
    assert value(delist(F.array(F.lit("a")))) == "a"
    assert value(delist(F.array().cast("array<string>"))) is None
    with pytest.raises(PySparkException):
        value(delist(F.array(F.lit("a"), F.lit("b"))))


# --- counts --------------------------------------------------------------------


def test_bounds():
    assert bounds(exact=2) == (2, 2) and bounds(minimum=1) == (1, None)
    for bad in ({"exact": 1, "minimum": 1}, {"minimum": 3, "maximum": 2}):
        with pytest.raises(ValueError):
            bounds(**bad)


def test_constrain(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    found = {r["k"]: r["outcome"] for r in constrain(rows, ["k"], exact=1).collect()}
    assert found == {"a": "too many", "b": "ok"}
    assert {r["k"]: r["v"] for r in one(rows, ["k"], "v").collect()} == {"a": None, "b": 3}
    with pytest.raises(PySparkException):
        constrain(rows, ["k"], minimum=2, strict=True).collect()


# --- phrases -------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, expected",
    [
        ("apple pie", "an"), ("pear", "a"), ("hour late", "an"), ("'unit'", "a"), ("(egg)", "an"),
        ("8-legged", "an"), ("11", "an"), ("110", "a"), ("1,100", "an"), ("11,000", "an"),
        ("1100", "an"), ("18,000,000", "an"), ("180", "a"), ("80", "an"), ("08", "a"), ("U.N. post", "a"),
        ("e-mail", "an"), ("9", "a"),
    ],
)
def test_articles(value, text, expected):
    odd = ["hour", "unit", "u"]
    assert value(phrases.article(F.lit(text), odd)) == expected


def test_article_table(spark):
    rows = spark.createDataFrame([("hour glass",), ("owl",), ("house",)], "t string")
    odd = spark.createDataFrame([("hour",)], "word string")
    found = {r["n"] for r in phrases.with_articles(rows, "t", odd, "n").collect()}
    assert found == {"an hour glass", "an owl", "a house"}


def test_exception_words(spark):
    words = spark.createDataFrame(
        [("one", [["W", "AH1", "N"]]), ("hour", [["AW1", "R"]]), ("owl", [["AW1", "L"]]), ("cat", [["K"]])],
        "word string, pronunciations array<array<string>>",
    )
    found = {r["word"]: r["kind"] for r in phrases.exception_words(words).collect()}
    assert found == {"one": "consonant_sounding_vowel_led", "hour": "vowel_sounding_consonant_led"}


@pytest.mark.parametrize(
    "number, forms, specs, expected",
    [
        (0, "lea/f/ves", [], "0 leaves"), (1, "lea/f/ves", [], "1 leaf"), (2, "child/ren", [], "2 children"),
        (1, "sheep", [], "1 sheep"), (1, "/person/people", ["1=$a $thing"], "a person"),
        (0, "oas/is/es", ["0=no $things;0.5=half $a $thing"], "no oases"),
        (0.5, "oas/is/es", ["0=no $things;0.5=half $a $thing"], "half an oasis"),
        (11, "ticket/s", ["n=$a ${n}-zone $thing costs $$5"], "an 11-zone ticket costs $5"),
        (3, None, ["n=$n $things"], "3 $things"),
    ],
)
def test_counted_phrases(value, number, forms, specs, expected):
    assert value(phrases.count_phrase(F.lit(number), forms, *specs)) == expected


def test_bad_phrase_spec():
    with pytest.raises(ValueError):
        phrases.parse_phrases("1=a=b")


@pytest.mark.parametrize(
    "text, fmt, expected",
    [
        ("Tue 3 Mar 2020 04:05 PM", "%a %d %b %Y %I:%M %p", "2020-03-03 16:05:00"),
        ("12:30 am", "%I:%M %p", "1900-01-01 00:30:00"),
        ("2020-060", "%Y-%j", "2020-02-29 00:00:00"),
        ("Friday, 1 May 2020 UTC", "%A, %d %B %Y %Z", "2020-05-01 00:00:00"),
        ("2020-05-01T10:11+02:30", "%Y-%m-%dT%H:%M%z", "2020-05-01 10:11:00"),
        ("Fryday 2020", "%A %Y", None),
    ],
)
def test_more_date_directives(value, text, fmt, expected):
    from datetime import datetime

    found = value(dates.strptime(F.lit(text), [fmt])["ts"].cast("string"))
    assert found == expected
    if expected:
        assert datetime.strptime(text, fmt).replace(tzinfo=None) == datetime.fromisoformat(expected)


def test_a_code_outside_the_enumeration_fails(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 4), ("a", 9)], "k string, c int")
    small = enums.Enumeration.of("Small", LOW=0, MID=1, HIGH=2)
    with pytest.raises(Exception):
        small.consolidate(rows, ["k"], "c", lambda a, b: F.greatest(a, b)).collect()

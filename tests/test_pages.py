import pytest
from pyspark.sql import functions as F

from gleanery.functions.records import Field, Model
from gleanery.operators.fields import (
    Context, DefinitionError, choose_method, choose_scope, compile_field, derive_fields,
    select_targets,
)
from gleanery.operators.html import element_attribute, element_text, with_nodes
from gleanery.operators.items import explode_items, valid_items
from gleanery.operators.select import SelectorError, find_all, find_first, xpath

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title>
<meta name="author" content="Ann"><meta name="author" content="Bob"><script>var x = "<p>no</p>";</script>
</head><body><div id="top" class="box  wide"><p>One <b>bold<p>Two
 lines<br>here</div><ul><li>first<li class=x><a href="/a?b=1&amp;c=2">Link</a><li>third</ul>
<table><tr><td>1<td>2<tr><td>3<td title='t'>4</table></body>"""


@pytest.fixture
def page(spark):
    return with_nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string"))


def texts(page, method, selector):
    found = F.transform(find_all(F.col("nodes"), method, selector), element_text)
    return page.filter("id = 1").select(found.alias("t")).head()["t"]


@pytest.mark.parametrize(
    "method, selector, expected",
    [
        ("tag_name", "title", ["A & B"]),
        ("tag_name", "TD", ["1", "2", "3", "4"]),
        ("class_name", "box", ["One boldTwo lineshere"]),
        ("class_name", "bo", []),
        ("id", "top", ["One boldTwo lineshere"]),
        ("name", "author", ["", ""]),
        ("link_text", "Link", ["Link"]),
        ("link_text", "Lin", []),
        ("partial_link_text", "in", ["Link"]),
        ("css_selector", "ul > li.x a", ["Link"]),
        ("css_selector", "#top p, td[title=t]", ["One bold", "Two lineshere", "4"]),
        ("css_selector", "[title]", ["4"]),
        ("css_selector", "body > p", []),
        ("xpath", "//table/tr[2]/td[1]", ["3"]),
        ("xpath", "//li[2]/a", ["Link"]),
        ("xpath", "(//td)[3]", ["3"]),
        ("xpath", "(//td)[3]/..", ["34"]),
        ("xpath", "//td[@title='t']", ["4"]),
        ("xpath", "//td[@title]", ["4"]),
        ("xpath", "//div[contains(concat(' ', @class, ' '), ' wide ')]/p[1]", ["One bold"]),
        ("xpath", "//li[text()='first']", ["first"]),
        ("xpath", "(//*[text()[contains(.,'third')]])[1]/..", ["firstLinkthird"]),
        ("xpath", "//title | //li[3]", ["A & B", "third"]),
        ("xpath", ".//a[contains(@href, 'c=2')]", ["Link"]),
        ("xpath", "./html/body/ul/li[1]", ["first"]),
    ],
)
def test_selectors(page, method, selector, expected):
    assert texts(page, method, selector) == expected


def test_unclosed_tags_and_entities(page):
    row = page.filter("id = 1").select(
        F.size(find_all(F.col("nodes"), "tag_name", "p")).alias("p"),
        F.size(find_all(F.col("nodes"), "tag_name", "li")).alias("li"),
        element_attribute(find_first(F.col("nodes"), "tag_name", "a"), "href").alias("href"),
        element_text(find_first(F.col("nodes"), "tag_name", "script")).alias("script"),
    ).head()
    assert (row["p"], row["li"], row["href"], row["script"]) == (2, 3, "/a?b=1&c=2", "")


@pytest.mark.parametrize(
    "html, expected",
    [
        ("a < b &amp; c", [(1, "#text", "a < b & c")]),
        ("<title>a<b>&lt;</title>", [(1, "title", None), (2, "#text", "a<b><")]),
        ("<script>if(a<b){'</p>'}</SCRIPT >z", [(1, "script", None), (2, "#data", "if(a<b){'</p>'}"), (1, "#text", "z")]),
        ("x<!-- <p> -->y<!-- open", [(1, "#text", "x"), (1, "#text", "y")]),
        ("<P/>t</p></i>u", [(1, "p", None), (2, "#text", "t"), (1, "#text", "u")]),
        ("<p>a<div>b", [(1, "p", None), (2, "#text", "a"), (1, "div", None), (2, "#text", "b")]),
        ("<br/><img src='a>b'>c", [(1, "br", None), (1, "img", None), (1, "#text", "c")]),
        ("<ul><li>a<ul><li>b</ul>c<li>d", [(1, "ul", None), (2, "li", None), (3, "#text", "a"), (3, "ul", None),
         (4, "li", None), (5, "#text", "b"), (3, "#text", "c"), (2, "li", None), (3, "#text", "d")]),
        ('x<div class="open', [(1, "#text", "x")]),
    ],
)
def test_tolerant_reading(spark, html, expected):
    nodes = with_nodes(spark.createDataFrame([(html,)], "html string")).head()["nodes"]
    assert [(n["depth"], n["tag"], n["text"]) for n in nodes[1:]] == expected


def test_attributes(spark):
    html = """<A HREF="?a=1&copy=2&amp;b" Href=no data-x='q"q' hidden empty="" bare=/a/b?c=d>t</A>"""
    nodes = with_nodes(spark.createDataFrame([(html,)], "html string")).head()["nodes"]
    assert nodes[1]["attrs"] == {
        "href": "?a=1&copy=2&b", "data-x": 'q"q', "hidden": "", "empty": "", "bare": "/a/b?c=d"
    }


def test_absent_pages_have_no_nodes(page):
    counts = {r["id"]: r["n"] for r in page.select("id", F.size("nodes").alias("n")).collect()}
    assert counts[2] == 0 and counts[3] == 1


@pytest.mark.parametrize("text", ["//a[last()]", "//a/following-sibling::b", "../x", "//a[position()>2]"])
def test_unsupported_paths_are_refused(spark, text):
    with pytest.raises(SelectorError):
        xpath(text)


def test_one_parsing_pass_for_many_selectors(page):
    wide = page.select(
        *[element_text(find_first(F.col("nodes"), "tag_name", t)).alias(t) for t in ("p", "li", "td", "a")]
    )
    filtered = wide.filter("p <> 'x' and a is not null")
    items = explode_items(page, {"is_multiple": True, "tag_name": "li"}).filter("index > 1")
    for df in (wide, filtered, items):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


# --- operations ----------------------------------------------------------------

METHODS = [
    ({"class_name": "a"}, ("class_name", ["a"])),
    ({"other": 1, "class_name": ["a", "b"]}, ("class_name", ["a", "b"])),
    ({"class_name": None}, ("class_name", [])),
    ({"other": "a"}, (None, [])),
]


@pytest.mark.parametrize("operation, expected", METHODS)
def test_choose_method(operation, expected):
    assert choose_method(operation, "find") == expected


def test_two_methods_of_a_kind_are_refused():
    with pytest.raises(DefinitionError):
        choose_method({"class_name": "a", "xpath": "//b"}, "find")


def test_scopes(value):
    assert choose_scope({}) == "latest" and choose_scope({"scope": "PAGE"}) == "page"
    with pytest.raises(DefinitionError):
        choose_scope({"scope": "sideways"})
    lists = [F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))]
    choose = lambda scope: value(select_targets(scope, *lists, F.lit(7), F.lit(8)))
    assert [choose(s) for s in ("latest", "prior", "parent", "page")] == [[1, 2], [3], [7], [8]]


LINK = Model(
    "Link",
    (
        Field("source_url"), Field("rank", "int"), Field("title"), Field("names"),
        Field("day", "timestamp", "precision"), Field("precision", "granularity"), Field("label"),
        Field("doi"), Field("kind"),
    ),
)


def derive(page, content, **options):
    return derive_fields(page.filter("id = 1").select("nodes"), LINK, content, "nodes", "nodes", None, **options)


def test_series_and_references(page):
    content = {
        "source_url": {"tag_name": "a", "attribute": "href", "parse": ["{value}?{}"]},
        "title": [{"is_multiple": True, "tag_name": "li"}, {"getattr": "text"}],
        "names": {"is_multiple": True, "name": "author", "attribute": "content", "join": "; "},
        "day": {"tag_name": "td", "getattr": "text", "format": "200{value}", "excise": ["x"]},
        "kind": "page",
        "doi": {"get": "<names>", "format": "doi:{value}/{kind}/{source_url}"},
        "label": {"scope": "page", "tag_name": "li", "getattr": "text", "split": "s"},
    }
    row = derive(page, {k: v for k, v in content.items() if k not in ("doi", "label")}).head()
    assert row["source_url"] == "/a" and row["title"] == "third" and row["names"] == "Ann; Bob"
    assert row["kind"] == "page" and row["rank"] is None
    missing = {e["field"]: e["reason"] for e in row["_errors"]}
    assert missing == {f: "no definition" for f in ("rank", "precision", "label", "doi")}


def test_dates_and_precision(page):
    content = {
        "day": [
            {"tag_name": "td", "getattr": "text", "format": "1 March 200{value}"},
            {"strptime": ["%d/%m/%Y", "%d %B %Y"]},
        ],
        "precision": {"get": "<day.granularity>"},
        "label": {"get": "<day.granularity.name>"},
    }
    row = derive(page, content).head()
    assert str(row["day"]) == "2001-03-01 00:00:00"
    assert (row["precision"], row["label"]) == (3, "DAY")


def test_a_failing_field_leaves_the_row(page):
    content = {
        "source_url": {"tag_name": "nothing", "getattr": "text"},
        "title": {"tag_name": "title", "getattr": "text"},
        "day": [{"tag_name": "title", "getattr": "text"}, {"strptime": "%Y"}],
        "precision": {"get": "<day.granularity>"},
        "label": {"class_name": "box", "getattr": "text", "parse": "no such {value}"},
        "names": {"is_multiple": True, "tag_name": "nothing", "getattr": "text", "join": ","},
        "doi": {"is_multiple": True, "tag_name": "meta", "attribute": "absent", "join": ","},
        "kind": {"get": "<later>"},
    }
    row = derive(page, content).head()
    assert row["title"] == "A & B" and row["source_url"] is None
    assert row["day"] is None and row["precision"] is None
    # A text no template fits is dropped without an error; no texts join to ''.
    assert row["label"] is None and row["names"] == ""
    reasons = {e["field"] for e in row["_errors"]}
    assert reasons == {"source_url", "day", "doi", "kind", "rank"}


def test_list_fields_need_a_join(page):
    content = {"names": {"is_multiple": True, "tag_name": "li", "getattr": "text"}}
    with pytest.raises(DefinitionError):
        derive(page, content)
    assert derive(page, content, keep_lists=True).head()["names"] == ["first", "Link", "third"]


def test_given_fields_are_kept(page):
    given = page.filter("id = 1").select("nodes", F.lit("kept").alias("title"))
    derived = derive_fields(given, LINK, {"title": "replaced"}, "nodes", "nodes", None)
    assert derived.head()["title"] == "kept"


def test_clicks_are_refused(spark):
    with pytest.raises(DefinitionError):
        compile_field({"tag_name": "a", "click": True}, Context(F.col("nodes"), None, {}))


def test_items(page):
    items = explode_items(page, {"is_multiple": True, "tag_name": "li"})
    model = Model("Link", (Field("source_url"),))
    derived = derive_fields(items, model, {"source_url": {"tag_name": "a", "attribute": "href"}})
    assert [r["index"] for r in items.orderBy("index").collect()] == [1, 2, 3]
    assert [r["index"] for r in valid_items(derived).collect()] == [2]


def test_selectors_may_use_the_index_and_fields(spark):
    html = "<ul><li id=r1 class=a>x<i name=ax>1</i><li id=r2 class=b>y<i name=ay>2</i></ul><p id='{r}'>z</p>"
    page = with_nodes(spark.createDataFrame([(html,)], "html string"))
    items = explode_items(page, {"is_multiple": True, "tag_name": "li"}, keep_page=True)
    content = {
        "source_url": [{"scope": "page", "id": "r{index}"}, {"attribute": "class"}],
        "title": {"xpath": "//li[@id='r{index}']/i", "getattr": "text"},
        "names": [{"scope": "page", "css_selector": "li.<source_url> i"}, {"getattr": "text"}],
        "label": [{"scope": "page", "id": "{{r}}"}, {"getattr": "text"}],
    }
    derived = derive_fields(items, LINK, content, page="nodes")
    rows = [(r["source_url"], r["title"], r["names"], r["label"]) for r in derived.orderBy("index").collect()]
    assert rows == [("a", "1", "1", "z"), ("b", "2", "2", "z")]


def test_typed_templates_are_refused(spark):
    from gleanery.functions.templates import TemplateError, parse_templates

    with pytest.raises(TemplateError):
        parse_templates(F.col("x"), ["{value:d}"])


def test_a_single_item_is_one_row(page):
    assert explode_items(page, {"is_multiple": True, "tag_name": "ul"}).count() == 1


# --- damaged markup ------------------------------------------------------------


@pytest.mark.parametrize(
    "html, tag, attribute, expected",
    [
        ('<p class=a">one</p>', "p", "class", ('a"', "one")),
        ("<p class='a>one</p>", "p", "class", ("", "one")),
        ('<a href=/x/y?z="1">two</a>', "a", "href", ('/x/y?z="1"', "two")),
        ('<a href = "u" title=>three</a>', "a", "href", ("u", "three")),
        ("<![CDATA[ hidden <p>four</p>", "p", "class", (None, None)),
        ("<p>five</p", "p", "class", (None, "five")),
    ],
)
def test_damaged_markup(spark, html, tag, attribute, expected):
    from gleanery.operators.html import element_attribute, element_text, with_nodes
    from gleanery.operators.select import find_first

    found = find_first(F.col("nodes"), "tag_name", tag)
    row = with_nodes(spark.createDataFrame([(html,)], "html string")).select(
        element_attribute(found, attribute).alias("a"), element_text(found).alias("t")
    ).head()
    assert (row["a"], row["t"] or None) == expected


@pytest.mark.parametrize("piece", ["<![CDATA[ x ", "</x ", "<a ", '<a b="', "<a b='x ", "<!-- ", "<p class=a\"> ", '"=\' <'])
def test_damaged_markup_is_read_in_linear_time(piece):
    import time

    from gleanery.operators.html import _TreeReader

    begin = time.process_time()
    _TreeReader().read(piece * (5_000_000 // len(piece)))
    assert time.process_time() - begin < 40

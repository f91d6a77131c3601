"""Pages to element trees: one Arrow-batched pass over the raw HTML.

Each page becomes ``array<struct<pre, post, parent, depth, nth, nth_any, tag, attrs, text>>``
in document order. ``pre`` is the position in the page (0 is the document),
``post`` the last position inside the element, so a subtree is a slice; ``nth`` and
``nth_any`` are an element's place among its siblings of its tag and of any. Text is
stored once, in its own ``#text`` node; script and style bodies are ``#data``.
Everything after this pass is native column work.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.binding import let
from gleanery.session import self_contained

self_contained(__name__)

NODE_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField(name, T.IntegerType()) for name in ("pre", "post", "parent", "depth", "nth", "nth_any")]
        + [
            T.StructField("tag", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("text", T.StringType()),
        ]
    )
)

# Elements without an end tag, and which start tags end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
IMPLIED_END = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody"), ("table",)),
    "body": (("head",), ("html",)),
}
PARAGRAPH_SCOPE = ("table", "td", "th", "button")


# Elements whose body is text up to their end tag; those never shown.
RAW_TEXT = ("script", "style", "title", "textarea")
UNSHOWN = ("script", "style")

# Every construct may also end with the page, so none is scanned to the end more than once. A
# quote that is not closed belongs to a name; one inside an unquoted value belongs to the value.
MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/=]++"
    r"|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)?+)*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^\s>]++)))?+"
)
ATTRIBUTE_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(?:;|(?![=a-zA-Z0-9]))")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}


class _TreeReader:
    """Appends pages' nodes to flat column lists; tolerant of unclosed tags."""

    def __init__(self) -> None:
        self.offsets = [0]
        self.pre, self.post, self.parent, self.depth = [], [], [], []
        self.nth, self.nth_any = [], []
        self.tag, self.text = [], []
        self.attr_offsets, self.names, self.values = [0], [], []

    def read(self, html: str | None) -> None:
        self.base = len(self.pre)
        self.open: list[int] = []
        self.siblings: dict[tuple[int, str], int] = {}
        if html is not None:
            self.open.append(self._add("#document"))
            self._read_markup(html)
            self._pop_to(0)
        self.offsets.append(len(self.pre))

    def _read_markup(self, html: str) -> None:
        at, size = 0, len(html)
        while found := MARKUP.search(html, at):
            if found.start() > at:
                self._add("#text", text=unescape(html[at : found.start()]))
            at = found.end()
            if found["start"] and html[at - 1] != ">":
                break  # a tag that the page's end cuts off is nothing
            if found["start"]:
                tag = found["start"].lower()
                self._start(tag, found["attrs"])
                if tag in RAW_END:
                    end = RAW_END[tag].search(html, at)
                    stop = end.start() if end else size
                    if stop > at:
                        body = html[at:stop]
                        if tag in UNSHOWN:
                            self._add("#data", text=body)
                        else:
                            self._add("#text", text=unescape(body))
                    at = stop
            elif found["end"]:
                tag = found["end"].lower()
                if tag not in VOID:
                    self._close_open((tag,), ())
        if at < size:
            self._add("#text", text=unescape(html[at:]))

    def _add(self, tag: str, attrs: str = "", text: str | None = None) -> int:
        position = len(self.pre) - self.base
        self.pre.append(position)
        self.post.append(position)
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.nth.append(self._place(tag))
        self.nth_any.append(self._place("*") if tag[0] != "#" else 0)
        self.tag.append(tag)
        self.text.append(text)
        if attrs:
            self._add_attributes(attrs)
        self.attr_offsets.append(len(self.names))
        return position

    def _place(self, tag: str) -> int:
        key = (self.open[-1] if self.open else -1, tag)
        self.siblings[key] = place = self.siblings.get(key, 0) + 1
        return place

    def _add_attributes(self, attrs: str) -> None:
        seen = set()
        for name, double, single, bare in ATTRIBUTE.findall(attrs):
            name = name.lower()
            if name not in seen:
                seen.add(name)
                value = double or single or bare
                if "&" in value:
                    value = ATTRIBUTE_REFERENCE.sub(lambda m: unescape(m[0]), value)
                self.names.append(name)
                self.values.append(value)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_open(("p",), PARAGRAPH_SCOPE)
        if tag in IMPLIED_END:
            self._close_open(*IMPLIED_END[tag])
        position = self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(position)

    def _pop_to(self, level: int) -> None:
        last = len(self.pre) - self.base - 1
        while len(self.open) > level:
            self.post[self.base + self.open.pop()] = last

    def _close_open(self, tags, scope) -> None:
        """Close the nearest open element of these tags, unless the scope is met first."""
        for level in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.base + self.open[level]]
            if tag in tags:
                self._pop_to(level)
                return
            if tag in scope:
                return

    def to_arrow(self) -> pa.Array:
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()),
            pa.array(self.names, pa.string()),
            pa.array(self.values, pa.string()),
        )
        ints = [pa.array(c, pa.int32()) for c in (self.pre, self.post, self.parent, self.depth, self.nth, self.nth_any)]
        nodes = pa.StructArray.from_arrays(
            [*ints, pa.array(self.tag, pa.string()), attrs, pa.array(self.text, pa.string())],
            names=["pre", "post", "parent", "depth", "nth", "nth_any", "tag", "attrs", "text"],
        )
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), nodes)


@F.arrow_udf(NODE_TYPE)
def _page_nodes(html: pa.Array) -> pa.Array:
    reader = _TreeReader()
    for page in html.to_pylist():
        reader.read(page)
    return reader.to_arrow()


# Not deterministic as far as Catalyst is told: a filter on something read from the
# nodes would otherwise be pushed below the pass and parse every page a second time.
# Filters on other columns belong before ``with_nodes``.
page_nodes = _page_nodes.asNondeterministic()


def with_nodes(pages: DataFrame, html: str = "html", name: str = "nodes") -> DataFrame:
    """Add the ``nodes`` column and drop the raw HTML, which nothing needs afterwards."""
    return pages.withColumn(name, page_nodes(F.col(html))).drop(html)


def subtree(within: Column, node: Column) -> Column:
    """An element as its own slice of ``within``; the first entry is the element."""
    base = F.get(within, F.lit(0))["pre"]
    return F.slice(within, node["pre"] - base + 1, node["post"] - node["pre"] + 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s\\x{00A0}]+", " "))


def element_text(element: Column) -> Column:
    """Text of an element: its text nodes in order, whitespace collapsed."""
    texts = F.filter(element, lambda n: n["tag"] == "#text")
    return collapse(F.array_join(F.transform(texts, lambda n: n["text"]), ""))


def element_attribute(element: Column, name: Column | str) -> Column:
    """Attribute of an element, null when absent."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(F.get(element, F.lit(0))["attrs"], F.lower(key))


__all__ = [
    "NODE_TYPE", "collapse", "element_attribute", "element_text", "let", "page_nodes", "subtree",
    "with_nodes",
]

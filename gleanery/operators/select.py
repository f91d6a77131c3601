"""Selectors compiled to filters over a page's node array.

Every selector becomes a list of steps; a step is an axis, a tag test and
conditions. Evaluation is a chain of higher-order functions on one row, so no
selector ever shuffles. An element value is its subtree slice of the array.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.operators.html import collapse, element_text, let, subtree

Condition = Callable[[Column, Column], Column]  # (nodes, node) -> boolean


class SelectorError(ValueError):
    """A selector outside the supported subset."""


@dataclass
class Step:
    axis: str  # child, descendant or parent
    tag: str = "*"
    conditions: list = field(default_factory=list)  # Condition, or an int / Column position


@dataclass
class Path:
    steps: list
    absolute: bool = False
    index: object = None  # position of one match among all, 1-based
    after: list = field(default_factory=list)  # steps applied after the index


def _is_element(node: Column) -> Column:
    return ~node["tag"].startswith("#")


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_token(name: str, token: Column) -> Condition:
    def condition(nodes, node):
        words = F.split(F.coalesce(_attr(node, name), F.lit("")), r"\s+")
        return F.array_contains(words, token)

    return condition


def attr_equals(name: str, value: Column) -> Condition:
    return lambda nodes, node: F.coalesce(_attr(node, name) == value, F.lit(False))


def attr_contains(name: str, value: Column) -> Condition:
    return lambda nodes, node: F.coalesce(F.contains(_attr(node, name), value), F.lit(False))


def attr_present(name: str) -> Condition:
    return lambda nodes, node: _attr(node, name).isNotNull()


def own_text(test: Callable[[Column], Column]) -> Condition:
    """Some direct text node passes the test."""
    return lambda nodes, node: F.exists(
        subtree(nodes, node),
        lambda t: (t["tag"] == "#text") & (t["parent"] == node["pre"]) & test(t["text"]),
    )


def whole_text(test: Callable[[Column], Column]) -> Condition:
    return lambda nodes, node: test(element_text(subtree(nodes, node)))


def _has_tag(step: Step, node: Column) -> Column:
    return _is_element(node) if step.tag == "*" else node["tag"] == step.tag


def _meets(step: Step, nodes: Column, node: Column, test: Column, upto: int | None = None) -> Column:
    """``test`` and the step's conditions, the cheap test first."""
    for number, condition in enumerate(step.conditions[:upto]):
        if callable(condition):
            test = test & condition(nodes, node)
        else:
            test = test & (_place(step, nodes, node, number) == condition)
    return test


def _place(step: Step, nodes: Column, node: Column, upto: int) -> Column:
    """Place of a node among its siblings that pass the earlier conditions."""
    if not upto:
        return node["nth_any"] if step.tag == "*" else node["nth"]
    siblings = F.filter(
        nodes,
        lambda m: _meets(
            step, nodes, m,
            (m["parent"] == node["parent"]) & (m["pre"] <= node["pre"]) & _has_tag(step, m), upto,
        ),
    )
    return F.size(siblings)


def _apply(step: Step, nodes: Column, current: Column | None) -> Column:
    """Nodes reached by one step; ``current`` None means the context element.

    Children and descendants are looked for in each current node's own slice, so a step
    costs what the slices hold and not their number times the page.
    """
    if current is None:
        root = F.get(nodes, F.lit(0))["pre"]
        if step.axis == "child":
            related = lambda n: n["parent"] == root
        else:
            related = lambda n: n["pre"] > root
        return F.filter(nodes, lambda n: _meets(step, nodes, n, _has_tag(step, n) & related(n)))
    if step.axis == "parent":
        up = F.transform(current, lambda c: c["parent"])
        places = F.array_sort(F.array_distinct(up))
        return let(
            F.filter(_nodes_at(nodes, places), lambda n: _is_element(n)),
            lambda found: F.filter(found, lambda n: _meets(step, nodes, n, _has_tag(step, n))),
        )
    base = F.get(nodes, F.lit(0))["pre"]

    def below(c: Column) -> Column:
        inside = F.slice(nodes, c["pre"] - base + 2, c["post"] - c["pre"])
        own = (lambda n: n["parent"] == c["pre"]) if step.axis == "child" else (lambda n: F.lit(True))
        met = F.filter(inside, lambda n: _meets(step, nodes, n, _has_tag(step, n) & own(n)))
        return F.transform(met, lambda n: n["pre"])

    places = F.flatten(F.transform(current, below))
    # Nodes inside one another reach some nodes twice and out of order.
    return let(F.array_sort(F.array_distinct(places)), lambda p: _nodes_at(nodes, p))


def _nodes_at(nodes: Column, places: Column) -> Column:
    base = F.get(nodes, F.lit(0))["pre"]
    return F.transform(F.filter(places, lambda p: p >= base), lambda p: F.get(nodes, p - base))


def _walk(nodes: Column, path: Path) -> Column:
    def run(steps: list[Step], current: Column | None, finish) -> Column:
        if not steps:
            return finish(current)
        return let(_apply(steps[0], nodes, current), lambda c: run(steps[1:], c, finish))

    if path.index is None:
        return run(path.steps, None, lambda c: c)
    return run(
        path.steps,
        None,
        lambda c: let(F.slice(c, path.index, 1), lambda hit: run(path.after, hit, lambda x: x)),
    )


def find_nodes(nodes: Column, paths: list[Path]) -> Column:
    """All matching nodes below the element ``nodes``, in document order."""
    if len(paths) == 1:
        return _walk(nodes, paths[0])
    places = F.flatten(
        F.array(*[F.transform(_walk(nodes, path), lambda n: n["pre"]) for path in paths])
    )
    return let(places, lambda p: F.filter(nodes, lambda n: F.array_contains(p, n["pre"])))


# --- selector texts to steps -------------------------------------------------

# The path forms in use by site definitions.
_TOKEN = re.compile(
    r"contains\(\s*concat\(\s*' '\s*,\s*@([\w-]+)\s*,\s*' '\s*\)\s*,\s*(['\"])\s(.+?)\s\2\s*\)"
)
_ATTR_EQ = re.compile(r"@([\w-]+)\s*=\s*(['\"])(.*?)\2")
_ATTR_HAS = re.compile(r"contains\(\s*@([\w-]+)\s*,\s*(['\"])(.*?)\2\s*\)")
_ATTR = re.compile(r"@([\w-]+)")
_TEXT_EQ = re.compile(r"text\(\)\s*=\s*(['\"])(.*?)\1")
_TEXT_HAS = re.compile(
    r"(?:text\(\)\[contains\(\s*\.\s*,\s*(['\"])(.*?)\1\s*\)\]"
    r"|contains\(\s*text\(\)\s*,\s*(['\"])(.*?)\3\s*\))"
)
_WHOLE_HAS = re.compile(r"contains\(\s*\.\s*,\s*(['\"])(.*?)\1\s*\)")
_STEP = re.compile(r"(//|/)?(\.\.|\*|[A-Za-z][\w-]*)((?:\[(?:[^\[\]]|\[[^\[\]]*\])*\])*)")
_PREDICATE = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]")


def _predicate(text: str, render, index) -> object:
    text = text.strip()
    if text.isdigit():
        return int(text)
    if text == "{index}":
        return index
    if m := _TOKEN.fullmatch(text):
        return has_token(m[1], render(m[3]))
    if m := _ATTR_EQ.fullmatch(text):
        return attr_equals(m[1], render(m[3]))
    if m := _ATTR_HAS.fullmatch(text):
        return attr_contains(m[1], render(m[3]))
    if m := _ATTR.fullmatch(text):
        return attr_present(m[1])
    if m := _TEXT_EQ.fullmatch(text):
        value = render(m[2])
        return own_text(lambda t: t == value)
    if m := _TEXT_HAS.fullmatch(text):
        value = render(m[2] if m[2] is not None else m[4])
        return own_text(lambda t: F.contains(t, value))
    if m := _WHOLE_HAS.fullmatch(text):
        value = render(m[2])
        return whole_text(lambda t: F.contains(t, value))
    raise SelectorError(f"unsupported condition [{text}]")


def _path_steps(text: str, render, index, default_axis: str) -> list[Step]:
    steps, at, axis = [], 0, default_axis
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise SelectorError(f"unsupported path {text!r}")
        axis = {"//": "descendant", "/": "child", None: axis}[m[1]]
        conditions = [_predicate(p, render, index) for p in _PREDICATE.findall(m[3])]
        if m[2] == "..":
            if not steps:
                raise SelectorError("a path may not climb above its element")
            steps.append(Step("parent", "*", conditions))
        else:
            steps.append(Step(axis, m[2].lower(), conditions))
        at, axis = m.end(), "child"
    return steps


def _one_xpath(text: str, render, index) -> Path:
    text = text.strip()
    if text.startswith("("):
        m = re.fullmatch(r"\((.*)\)\[(\d+|\{index\})\]((?:/.*)?)", text, re.S)
        if not m:
            raise SelectorError(f"unsupported path {text!r}")
        inner = _one_xpath(m[1], render, index)
        inner.index = index if m[2] == "{index}" else int(m[2])
        # Steps after the index continue from the match found.
        inner.after = [] if not m[3] else _relative(m[3], render, index)
        return inner
    absolute = text.startswith("/")
    body = text[1:] if text.startswith("./") else text
    return Path(_path_steps(body, render, index, "child"), absolute)


def _relative(text: str, render, index) -> list[Step]:
    steps = _path_steps("/*" + text, render, index, "child")
    return steps[1:]


def xpath(text: str, render=F.lit, index=None) -> list[Path]:
    """Compile an XPath of the supported subset; ``|`` joins alternatives."""
    parts = re.split(r"\|(?![^\[\]]*\])", text)
    return [_one_xpath(part, render, index) for part in parts]


# A name may hold ``<field>`` and ``{index}`` tokens.
_CSS_NAME = r"((?:[\w-]|<[^<>]+>|\{index\})+)"
_CSS_PART = re.compile(
    r"([A-Za-z][\w-]*|\*)|\." + _CSS_NAME + "|#" + _CSS_NAME
    + r"|\[\s*([\w-]+)\s*(?:=\s*(['\"]?)(.*?)\5\s*)?\]"
)
_CSS_CHILD = re.compile(r"(<[^<>]+>)|\s*>\s*")


def _css_step(axis: str, text: str, render) -> Step:
    step, at = Step(axis), 0
    while at < len(text):
        m = _CSS_PART.match(text, at)
        if not m or (m[1] and at):
            raise SelectorError(f"unsupported selector {text!r}")
        if m[1]:
            step.tag = m[1].lower()
        elif m[2]:
            step.conditions.append(has_token("class", render(m[2])))
        elif m[3]:
            step.conditions.append(attr_equals("id", render(m[3])))
        elif m[6] is not None:
            step.conditions.append(attr_equals(m[4], render(m[6])))
        else:
            step.conditions.append(attr_present(m[4]))
        at = m.end()
    return step


def css(text: str, render=F.lit) -> list[Path]:
    """Compile a CSS selector: tags, classes, ids, attributes, descendant and child."""
    paths = []
    for part in text.split(","):
        words = _CSS_CHILD.sub(lambda m: m[1] or " >", part.strip()).split()
        if not words:
            raise SelectorError(f"empty selector in {text!r}")
        paths.append(
            Path(
                [
                    _css_step("child" if w[0] == ">" else "descendant", w.lstrip(">"), render)
                    for w in words
                ]
            )
        )
    return paths


def selector(method: str, text: str, render=F.lit, index=None) -> list[Path]:
    """Compile one of the eight find methods; literal braces are written twice."""
    text = text.replace("{{", "{").replace("}}", "}")
    if method == "xpath":
        return xpath(text, render, index)
    if method == "css_selector":
        return css(text, render)
    value = render(text)
    if method == "tag_name":
        step = Step("descendant", "*", [lambda nodes, n: n["tag"] == F.lower(value)])
    elif method == "class_name":
        step = Step("descendant", "*", [has_token("class", value)])
    elif method in ("id", "name"):
        step = Step("descendant", "*", [attr_equals(method, value)])
    elif method == "link_text":
        step = Step("descendant", "a", [whole_text(lambda t: t == collapse(value))])
    elif method == "partial_link_text":
        step = Step("descendant", "a", [whole_text(lambda t: F.contains(t, value))])
    else:
        raise SelectorError(f"unknown find method {method!r}")
    return [Path([step])]


def is_absolute(paths: list[Path]) -> bool:
    """Whether a selector starts at the page even when used inside an element."""
    return any(path.absolute for path in paths)


def find_all(element: Column, method: str, text: str, render=F.lit, index=None) -> Column:
    """All matching elements, each as its subtree."""
    paths = selector(method, text, render, index)
    return let(element, lambda e: F.transform(find_nodes(e, paths), lambda n: subtree(e, n)))


def find_first(element: Column, method: str, text: str, render=F.lit, index=None) -> Column:
    """First matching element, null when there is none."""
    paths = selector(method, text, render, index)
    first = lambda e: F.slice(find_nodes(e, paths), 1, 1)
    found = let(element, lambda e: F.transform(first(e), lambda n: subtree(e, n)))
    return F.get(found, F.lit(0))

"""Template strings as columns: capture templates, ``<field>`` references, formats."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Resolve = Callable[[str], Column]

REFERENCE = re.compile(r"<([^<>]+)>")
SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-])")


class TemplateError(ValueError):
    """A template with parts that have no column form."""


def _fields(template: str) -> list[tuple[str, str | None]]:
    """(literal, field name) pairs of a brace template; typed fields are refused."""
    pairs = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if spec or conversion:
            raise TemplateError(f"field types are not supported: {template!r}")
        pairs.append((literal, name))
    return pairs


def escape_regex(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def _escape_column(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def _concat(pieces: list[Column]) -> Column:
    if not pieces:
        return F.lit("")
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def references(template: str) -> list[str]:
    """Names of the fields a template refers to, as ``field`` or ``field.part``."""
    return REFERENCE.findall(template)


def _pieces(template: str) -> list[tuple[bool, str]]:
    """Split into (is_reference, text) pieces."""
    parts = REFERENCE.split(template)
    return [(i % 2 == 1, part) for i, part in enumerate(parts) if part or i % 2 == 1]


def render_references(template: str, resolve: Resolve) -> Column:
    """Replace every ``<field>`` by the field's text; a null field becomes ``''``."""
    pieces = [
        F.coalesce(resolve(text).cast("string"), F.lit("")) if is_ref else F.lit(text)
        for is_ref, text in _pieces(template)
    ]
    return _concat(pieces)


def _capture_pattern(text: str) -> str:
    """Regex for a capture template without references; group 1 is ``{value}``."""
    out, captured = "", False
    for literal, name in _fields(text):
        out += escape_regex(literal)
        if name is None:
            continue
        if name == "value" and not captured:
            out, captured = out + "(.+?)", True
        elif name == "value":
            out += r"\1"
        else:
            out += ".+?"
    return out


def has_capture(template: str) -> bool:
    return any(name == "value" for _, name in _fields(template))


def capture_pattern(template: str, resolve: Resolve | None = None) -> Column:
    """Whole-string, case-insensitive pattern of a ``{}`` / ``{value}`` template.

    References may sit anywhere in it; their values are matched literally.
    """
    out: list[Column] = [F.lit(r"(?is)\A")]
    for is_ref, text in _pieces(template):
        if is_ref and resolve is not None:
            out.append(_escape_column(F.coalesce(resolve(text).cast("string"), F.lit(""))))
        else:
            out.append(F.lit(_capture_pattern(f"<{text}>" if is_ref else text)))
    out.append(F.lit(r"\z"))
    return _concat(out)


def parse_templates(value: Column, templates: list[str], resolve: Resolve | None = None) -> Column:
    """``{value}`` of the first template that matches the whole text, else null.

    A capture holds at least one character, so an empty extraction is a miss. A
    matching template without ``{value}`` ends the search with null.
    """
    result = F.lit(None).cast("string")
    for template in reversed(templates):
        pattern = capture_pattern(template, resolve)
        if has_capture(template):
            found = F.call_function("regexp_extract", value, pattern, F.lit(1))
            result = F.coalesce(F.nullif(found, F.lit("")), result)
        else:
            result = F.when(~F.regexp_like(value, pattern), result)
    return result


def parse_values(values: Column, templates: list[str], resolve: Resolve | None = None) -> Column:
    """Parse an array of texts: misses are dropped, nulls and ``''`` pass through."""
    parsed = F.transform(
        values,
        lambda v: F.when(
            v.isNull() | (v == ""), F.struct(v.alias("v"), F.lit(True).alias("kept"))
        ).otherwise(_kept(parse_templates(v, templates, resolve))),
    )
    return F.transform(F.filter(parsed, lambda p: p["kept"]), lambda p: p["v"])


def _kept(parsed: Column) -> Column:
    return F.struct(parsed.alias("v"), parsed.isNotNull().alias("kept"))


def format_template(template: str, value: Column, resolve: Resolve) -> Column:
    """``{value}`` and ``{field}`` substitution; a null part makes the result null."""
    out: list[Column] = []
    for literal, name in _fields(template):
        if literal:
            out.append(F.lit(literal))
        if name is not None:
            out.append((value if name == "value" else resolve(name)).cast("string"))
    return _concat(out)

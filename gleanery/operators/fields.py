"""Field definitions compiled to columns.

A field is a literal, one operation or a series of operations. An operation
runs, in this order: find, extract, get, parse, format, transform. Values travel
as arrays; an empty array is "no value". Each compiled field carries an error
text beside its values, so a failing step nulls one field and not the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import dates
from gleanery.functions.records import GRANULARITIES, Model
from gleanery.functions.templates import (
    format_template, parse_values, references, render_references,
)
from gleanery.operators.html import element_attribute, element_text, let, subtree
from gleanery.operators.select import find_nodes, is_absolute, selector

# The steps a definition may name, at most one of each kind.
METHODS = {
    "find": (
        "class_name", "css_selector", "id", "link_text", "name", "partial_link_text",
        "tag_name", "xpath",
    ),
    "extract": ("getattr", "attribute", "property"),
    "get": ("get",),
    "parse": ("parse", "strptime"),
    "format": ("format", "strftime"),
    "transform": ("excise", "join", "split"),
}
SCOPES = ("page", "parent", "prior", "latest")
ELEMENT = (
    "array<struct<pre:int,post:int,parent:int,depth:int,nth:int,nth_any:int,"
    "tag:string,attrs:map<string,string>,text:string>>"
)
NO_TEXT = "CAST(NULL AS STRING)"
TYPES = {"element": ELEMENT, "text": "string", "date": dates.GRANULAR_TYPE}


class DefinitionError(ValueError):
    """A field definition that cannot be compiled."""


def enlist(value: Column) -> Column:
    """A single value as a list; null is the empty list."""
    return F.array_compact(F.array(value))


def delist(values: Column) -> Column:
    """The only entry of a list; null when empty. Longer lists fail."""
    many = F.raise_error(F.lit("expected one value")).cast("string")
    return F.when(F.size(values) > 1, many).otherwise(F.get(values, F.lit(0)).cast("string"))


def _no_values(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{TYPES[kind]}>)")


@dataclass(frozen=True)
class Value:
    """Array column, what its entries are, whether it stays a list, first error."""

    values: Column
    kind: str
    many: bool = False
    error: Column | None = None
    row: Column | None = None  # values and error as one expression, evaluated together

    def with_error(self, test: Column, reason: str) -> Value:
        problem = F.when(test, F.lit(reason))
        error = problem if self.error is None else F.coalesce(self.error, problem)
        return Value(self.values, self.kind, self.many, error)

    def packed(self) -> Column:
        if self.row is not None:
            return self.row
        error = F.expr(NO_TEXT) if self.error is None else self.error
        return F.struct(self.values.alias("values"), error.alias("error"))

    def scalar(self) -> Column:
        """The first entry, or null where a step failed."""
        return let(
            self.packed(), lambda r: F.when(r["error"].isNull(), F.get(r["values"], F.lit(0)))
        )


def bind(value: Value, then: Callable[[Value], Value]) -> Value:
    """Evaluate ``value`` once and go on with it; the result's type is known here."""
    shape: list[Value] = []

    def body(r: Column) -> Column:
        out = then(Value(r["values"], value.kind, value.many, r["error"]))
        shape.append(out)
        return out.packed()

    result = let(value.packed(), body)
    return Value(result["values"], shape[0].kind, shape[0].many, result["error"], result)


@dataclass(frozen=True)
class Context:
    """What a field may look at: its element, the page, earlier fields, its position."""

    element: Column | None
    page: Column | None
    fields: dict[str, str]  # earlier field -> kind
    index: Column | None = None

    def resolve(self, reference: str) -> Column:
        name, *path = reference.split(".")
        if name not in self.fields:
            raise DefinitionError(f"<{reference}> refers to a field not derived before")
        value = F.col(name)
        if self.fields[name] == "date":
            if not path:
                return dates.serialize_granular(value)
            if path[0] != "granularity" or path[1:] not in ([], ["name"], ["value"]):
                raise DefinitionError(f"unknown part in <{reference}>")
            code = value["granularity"]
            return dates.granularity_label(code) if path[1:] == ["name"] else code
        for part in path:
            value = value[part]
        return value


def choose_method(operation: dict, kind: str) -> tuple[str | None, list]:
    """The one method of a kind an operation names, with its arguments."""
    named = [m for m in operation if m in METHODS[kind]]
    if len(named) > 1:
        raise DefinitionError(f"more than one {kind} method: {named}")
    if not named:
        return None, []
    arguments = operation[named[0]]
    if arguments is None:
        return named[0], []
    return named[0], arguments if isinstance(arguments, list) else [arguments]


def choose_scope(operation: dict) -> str:
    scope = str(operation.get("scope", "latest")).lower()
    if scope not in SCOPES:
        raise DefinitionError(f"unknown scope {scope!r}")
    return scope


def select_targets(scope: str, latest: Column, prior: Column, parent: Column, page: Column) -> Column:
    """Input list of an operation for its scope; parent and page are single values."""
    choices = {"latest": latest, "prior": prior, "parent": F.array(parent), "page": F.array(page)}
    return choices[scope]


def _only(arguments: list, what: str) -> str:
    if len(arguments) != 1:
        raise DefinitionError(f"{what} takes one argument, got {arguments!r}")
    return arguments[0]


def _some(arguments: list, what: str) -> list:
    if not arguments:
        raise DefinitionError(f"{what} needs an argument")
    return arguments


def _run(operation: dict, target: Value, ctx: Context) -> Value:
    """One operation over a target list, each step reading the one before."""
    if operation.get("click"):
        raise DefinitionError("clicking needs a live browser and is not supported")
    many = bool(operation.get("is_multiple", False))
    chosen = [(step, *choose_method(operation, kind)) for kind, step in _STEPS.items()]
    return _run_steps([c for c in chosen if c[1]], target, ctx, many)


def _run_steps(steps: list, value: Value, ctx: Context, many: bool) -> Value:
    if not steps:
        return value
    step, method, arguments = steps[0]
    out = step(value, method, arguments, ctx, many)
    return out if len(steps) == 1 else bind(out, lambda v: _run_steps(steps[1:], v, ctx, many))


def _find(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    if value.kind != "element":
        raise DefinitionError(f"{method} needs an element, not {value.kind}")
    render = lambda text: _selector_text(text, ctx)
    paths = selector(method, _only(arguments, method), render, ctx.index)
    within = value.values
    if is_absolute(paths):
        if ctx.page is None:
            raise DefinitionError("an absolute path needs the page")
        within = F.array(ctx.page)
    hits = lambda e: find_nodes(e, paths) if many else F.slice(find_nodes(e, paths), 1, 1)
    found = F.flatten(
        F.transform(within, lambda e: F.transform(hits(e), lambda n: subtree(e, n)))
    )
    out = Value(F.coalesce(found, _no_values("element")), "element", many, value.error)
    if many:
        return out
    return bind(out, lambda v: v.with_error(F.size(v.values) == 0, f"no element for {method}"))


def _selector_text(text: str, ctx: Context) -> Column:
    """Text within a selector, its ``<field>`` and ``{index}`` tokens replaced."""
    pieces = [render_references(p, ctx.resolve) for p in text.split("{index}")]
    if len(pieces) == 1:
        return pieces[0]
    if ctx.index is None:
        raise DefinitionError("{index} is known within items only")
    joined = [pieces[0]]
    for piece in pieces[1:]:
        joined += [ctx.index.cast("string"), piece]
    return F.concat(*joined)


def _extract(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    name = render_references(_only(arguments, method), ctx.resolve)
    if value.kind != "element":
        raise DefinitionError(f"{method} needs an element, not {value.kind}")
    if method == "getattr":
        if arguments != ["text"]:
            raise DefinitionError("getattr reads text only")
        read = element_text
    else:
        read = lambda e: element_attribute(e, name)
    return Value(F.transform(value.values, read), "text", many, value.error)


def _get(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    tags = []
    for argument in _some(arguments, method):
        names = references(argument)
        if not names:
            raise DefinitionError(f"{argument!r} is not a <field> reference")
        tags.append(names[0])
    if len(tags) == 1 and ctx.fields.get(tags[0]) == "date":
        return Value(F.array(F.col(tags[0])), "date", many, value.error)
    read = F.array(*[ctx.resolve(t).cast("string") for t in tags])
    return Value(read, "text", many or len(tags) > 1, value.error)


def _parse(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    templates = _some(arguments, method)
    if method == "parse":
        parsed = parse_values(value.values, templates, ctx.resolve)
        return Value(parsed, "text", many, value.error)
    parsed = F.transform(value.values, lambda v: dates.strptime(v, templates))

    def check(v: Value) -> Value:
        pairs = F.arrays_zip(value.values.alias("a"), v.values.alias("b"))
        failed = F.exists(pairs, lambda z: z["a"].isNotNull() & z["b"].isNull())
        return v.with_error(failed, "no date format fits")

    return bind(Value(parsed, "date", many, value.error), check)


def _format(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    template = _only(arguments, method)
    if method == "strftime":
        if value.kind != "date":
            raise DefinitionError("strftime needs a date")
        out = F.transform(value.values, lambda v: dates.strftime(v["ts"], template))
        result = Value(out, "text", many, value.error)
        return result.with_error(F.exists(value.values, lambda v: v.isNull()), "no date to format")
    as_text = dates.serialize_granular if value.kind == "date" else (lambda v: v)
    out = F.transform(
        value.values, lambda v: format_template(template, as_text(v), ctx.resolve)
    )
    return Value(out, "text", many, value.error)


def _transform(value: Value, method, arguments, ctx: Context, many: bool) -> Value:
    if value.kind != "text":
        raise DefinitionError(f"{method} needs text, not {value.kind}")
    rendered = [render_references(a, ctx.resolve) for a in _some(arguments, method)]
    null_entry = F.exists(value.values, lambda v: v.isNull())
    if method == "excise":
        def cleanse(v):
            for snippet in rendered:
                v = F.replace(v, snippet, F.lit(""))
            return v

        out = Value(F.transform(value.values, cleanse), "text", many, value.error)
    elif method == "join":
        joined = F.array_join(value.values, _only(arguments, method))
        out = Value(F.array(joined), "text", False, value.error)
    else:
        out = Value(split_values(value.values, _only(rendered, method)), "text", True, value.error)
    return out.with_error(null_entry, f"{method} of a missing value")


def split_values(values: Column, delimiter: Column) -> Column:
    """Split every text at a literal delimiter and flatten."""
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    return F.flatten(F.transform(values, lambda v: F.call_function("split", v, quoted)))


def join_values(values: Column, delimiter: str) -> Column:
    """Join texts; no texts give ``''``, a null among them gives null."""
    return F.when(~F.exists(values, lambda v: v.isNull()), F.array_join(values, delimiter))


def excise(text: Column, snippets: list[str]) -> Column:
    """Remove literal snippets, in order."""
    for snippet in snippets:
        text = F.replace(text, F.lit(snippet), F.lit(""))
    return text


_STEPS: dict[str, Callable] = {
    "find": _find, "extract": _extract, "get": _get, "parse": _parse, "format": _format,
    "transform": _transform,
}


def _threaded(value: Value) -> Value:
    """A lone null threads to the next operation as no value."""
    def thread(v: Value) -> Value:
        lone = (F.size(v.values) == 1) & F.get(v.values, F.lit(0)).isNull()
        kept = F.when(lone, _no_values(v.kind)).otherwise(v.values)
        return Value(kept, v.kind, v.many, v.error)

    return bind(value, thread)


def run_series(operations: list[dict], ctx: Context) -> Value:
    """Operations in a row; each reads the value its scope names.

    Without targets an operation is skipped and the value stays. A single-valued
    operation over several targets keeps the result of the last.
    """
    parent = Value(enlist(ctx.element), "element")
    page = None if ctx.page is None else Value(enlist(ctx.page), "element")

    def advance(todo: list[dict], latest: Value, prior: Value) -> Value:
        if not todo:
            return latest
        target = _series_target(choose_scope(todo[0]), latest, prior, parent, page)
        result = _series_step(todo[0], target, latest, ctx)
        return bind(result, lambda v: advance(todo[1:], v, latest))

    return bind(parent, lambda v: advance(list(operations), v, v))


def _series_target(scope: str, latest: Value, prior: Value, parent: Value, page) -> Value:
    target = {"latest": latest, "prior": prior, "parent": parent, "page": page}[scope]
    if target is None:
        raise DefinitionError("scope page needs the page")
    return Value(target.values, target.kind, target.many, latest.error)


def _series_step(operation: dict, target: Value, latest: Value, ctx: Context) -> Value:
    if operation.get("is_multiple", False):
        return _threaded(_run(operation, target, ctx))
    last = Value(F.slice(target.values, -1, 1), target.kind, False, target.error)
    result = _threaded(_run(operation, last, ctx))
    skip = F.size(target.values) == 0

    def settle(r: Value) -> Value:
        kept = latest.values if latest.kind == r.kind else _no_values(r.kind)
        before = F.expr(NO_TEXT) if latest.error is None else latest.error
        return Value(
            F.when(skip, kept).otherwise(r.values), r.kind, r.many,
            F.when(skip, before).otherwise(r.error),
        )

    return bind(result, settle)


def compile_field(definition, ctx: Context) -> Value:
    """A field definition (literal, operation or series) as a value."""
    if isinstance(definition, dict):
        target = Value(enlist(ctx.element), "element")
        return _threaded(bind(target, lambda v: _run(definition, v, ctx)))
    if isinstance(definition, list):
        return run_series(definition, ctx)
    text = None if definition is None else str(definition)
    return Value(F.array(F.lit(text).cast("string")), "text")


def needs_page(definition) -> bool:
    """Whether a definition looks beyond its own element."""
    operations = definition if isinstance(definition, list) else [definition]
    for op in operations:
        if isinstance(op, dict):
            method, arguments = choose_method(op, "find")
            if choose_scope(op) == "page":
                return True
            if method == "xpath" and arguments and is_absolute(
                selector("xpath", references_blank(arguments[0]), index=F.lit(1))
            ):
                return True
    return False


def references_blank(text: str) -> str:
    """Template with its references removed, for inspection without fields."""
    for name in references(text):
        text = text.replace(f"<{name}>", "")
    return text


def _names_used(definition) -> set[str]:
    used: set[str] = set()
    operations = definition if isinstance(definition, list) else [definition]
    for op in operations:
        if not isinstance(op, dict):
            continue
        for key, argument in op.items():
            for text in argument if isinstance(argument, list) else [argument]:
                if isinstance(text, str):
                    used |= {r.split(".")[0] for r in references(text)}
                    if key == "format":
                        used |= {p.split("}")[0].split(".")[0] for p in text.split("{")[1:]}
    return used - {"value", ""}


def derive_fields(
    items: DataFrame,
    model: Model,
    content: dict,
    element: str = "element",
    page: str | None = None,
    index: str | None = "index",
    keep_lists: bool = False,
) -> DataFrame:
    """Add every model field to ``items``, in model order, plus ``_errors``.

    Columns already present are kept. Keys outside the model are ignored; a model
    field without a definition is null. Fields are added in as few projections
    as their references allow.
    """
    present = set(items.columns)
    kinds: dict[str, str] = {c: "text" for c in present}
    batch: dict[str, Column] = {}
    errors: list[str] = []
    missing: list[str] = []
    df = items

    def flush():
        nonlocal df, batch
        if batch:
            df = df.withColumns(batch)
            results = [c for c in batch if c.startswith("__result_")]
            if results:
                df = df.withColumns(
                    {c.removeprefix("__result_"): F.col(f"{c}.value") for c in results}
                )
            batch = {}

    order = ["source_url"] + [n for n in model.names() if n != "source_url"]
    for name in order:
        if name in present:
            continue
        if name not in content:
            batch[name] = F.expr(NO_TEXT)
            kinds[name] = "none"
            missing.append(name)
            continue
        if _names_used(content[name]) & {c.removeprefix("__result_") for c in batch}:
            flush()
        ctx = Context(
            F.col(element), F.col(page) if page else None, dict(kinds),
            F.col(index) if index else None,
        )
        try:
            value = compile_field(content[name], ctx)
        except ValueError as problem:  # of the definition, a selector, a template or a date format
            value = Value(F.array(F.lit(None).cast("string")), "text", False,
                          F.lit(str(problem)))
        if value.many and not keep_lists:
            raise DefinitionError(f"{name} is a list: add a join, or allow lists")
        packed = let(value.packed(), lambda r: _result(r, value.many))
        if value.error is None:
            batch[name] = packed["value"]
        else:
            batch[f"__result_{name}"] = packed
            errors.append(name)
        kinds[name] = value.kind
    flush()
    reasons = [f"named_struct('field', '{n}', 'reason', `__result_{n}`.error)" for n in errors]
    reasons += [f"named_struct('field', '{n}', 'reason', 'no definition')" for n in missing]
    listed = f"array({', '.join(reasons)})" if reasons else "array()"
    typed = f"CAST({listed} AS array<struct<field:string,reason:string>>)"
    found = F.expr(f"filter({typed}, e -> e.reason IS NOT NULL)")
    df = df.withColumn("_errors", found).drop(*[f"__result_{n}" for n in errors])
    return _typed(df, model, kinds)


def _result(r: Column, many: bool) -> Column:
    value = r["values"] if many else F.get(r["values"], F.lit(0))
    return F.struct(
        F.when(r["error"].isNull(), value).alias("value"), r["error"].alias("error")
    )


def _typed(df: DataFrame, model: Model, kinds: dict[str, str]) -> DataFrame:
    """Dates become plain timestamps once every reference to them is resolved."""
    changes = {}
    for field in model.fields:
        if field.name not in df.columns:
            continue
        if kinds.get(field.name) == "date":
            changes[field.name] = F.col(f"{field.name}.ts")
        elif field.kind == "granularity":
            if kinds.get(field.name) == "none":
                changes[field.name] = F.expr("CAST(NULL AS TINYINT)")
                continue
            text = F.col(field.name)
            changes[field.name] = F.coalesce(
                text.try_cast("tinyint"), GRANULARITIES.from_qualified(text).cast("tinyint")
            )
        elif field.kind in ("timestamp", "int"):
            changes[field.name] = F.expr(f"try_cast(`{field.name}` AS {field.sql_type})")
    return df.withColumns(changes) if changes else df

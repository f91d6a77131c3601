"""Composite storage keys: qualifiers, then ``name=value`` fields, in one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term delimiter, assigner, value separator, null; machine and display form.
MACHINE = (chr(1), chr(2), chr(3), chr(0))
DISPLAY = ("&", "=", "|", "~")

FIELD_TYPE = "struct<name:string,values:array<string>>"


def key_field(name: str | Column, value: Column, many: bool = False) -> Column:
    """One field; a null value stays null, a single text becomes a one-entry list."""
    values = value if many else F.when(value.isNotNull(), F.array(value.cast("string")))
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), values.cast("array<string>").alias("values"))


def build_key(qualifiers: Column, fields: Column, display: bool = False) -> Column:
    """Key text from ``array<string>`` qualifiers and an array of fields."""
    term, assign, separator, null = DISPLAY if display else MACHINE
    packed = F.transform(
        fields,
        lambda f: F.concat(
            f["name"],
            F.lit(assign),
            F.coalesce(F.array_join(f["values"], separator), F.lit(null)),
        ),
    )
    terms = F.concat(qualifiers, packed)
    empty = F.raise_error(F.lit("a key needs a qualifier or a field")).cast("string")
    return F.when(F.size(terms) == 0, empty).otherwise(F.array_join(terms, term))


def encode_key(key: Column, charset: str = "utf-8") -> Column:
    return F.encode(key, charset)


def parse_key(key: Column, strict: bool = False) -> Column:
    """``struct<qualifiers, fields>`` of a key; display form is recognised.

    Where a qualifier follows a field the result is null, or an error if
    ``strict``. A repeated field keeps its first place and its last value.
    """
    machine = F.contains(key, F.lit(MACHINE[0])) | F.contains(key, F.lit(MACHINE[1]))
    return F.when(machine, _parse(key, MACHINE, strict)).otherwise(_parse(key, DISPLAY, strict))


def _parse(key: Column, marks: tuple[str, ...], strict: bool) -> Column:
    term, assign, separator, null = (F.lit(m) for m in marks)
    terms = F.split(key, _literal(marks[0]))
    is_field = lambda t: F.contains(t, assign)
    flags = F.transform(terms, is_field)
    first = F.array_position(flags, True).cast("int")
    cut = F.when(first > 0, first - 1).otherwise(F.size(terms))
    qualifiers = F.slice(terms, F.lit(1), cut)
    packed = F.slice(terms, cut + 1, F.size(terms))
    split = F.transform(packed, lambda t: F.split(t, _literal(marks[1])))
    sound = F.forall(split, lambda p: F.size(p) == 2)
    named = F.transform(
        split,
        lambda p: F.struct(
            F.get(p, F.lit(0)).alias("name"),
            F.when(F.get(p, F.lit(1)) != null, F.split(F.get(p, F.lit(1)), _literal(marks[2])))
            .alias("values"),
        ),
    )
    names = F.array_distinct(F.transform(named, lambda f: f["name"]))
    fields = F.transform(
        names, lambda n: F.element_at(F.filter(named, lambda f: f["name"] == n), -1)
    )
    result = F.struct(qualifiers.alias("qualifiers"), fields.alias("fields"))
    if strict:
        problem = F.raise_error(F.lit("key qualifiers must precede all fields"))
        return F.when(sound, result).otherwise(problem.cast("void"))
    return F.when(sound, result)


def _literal(mark: str) -> str:
    return "\\" + mark if mark in "|^$.*+?()[]{}" else mark

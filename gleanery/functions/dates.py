"""Dates with a known precision: ``struct<ts timestamp_ntz, granularity tinyint>``."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.binding import let, with_groups
from gleanery.functions.templates import escape_regex

# Precision codes, ISO prefixes, directives and month names.
GRANULARITY = {
    "YEAR": 1, "MONTH": 2, "DAY": 3, "HOUR": 4, "MINUTE": 5, "SECOND": 6, "MICROSECOND": 7,
}
ISO_FORMATS = {
    1: "yyyy",
    2: "yyyy-MM",
    3: "yyyy-MM-dd",
    4: "yyyy-MM-dd'T'HH",
    5: "yyyy-MM-dd'T'HH:mm",
    6: "yyyy-MM-dd'T'HH:mm:ss",
    7: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
MONTHS = (
    "january february march april may june july august september october november december"
).split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
DIRECTIVES = {
    "Y": r"(\d{4})",
    "y": r"(\d{2})",
    "B": "(" + "|".join(MONTHS) + ")",
    "b": "(" + "|".join(m[:3] for m in MONTHS) + ")",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(2[0-3]|[0-1]\d|\d)",
    "M": r"([0-5]\d|\d)",
    "S": r"([0-5]\d|\d)",
    "f": r"(\d{1,6})",
    "I": r"(1[0-2]|0[1-9]|[1-9])",
    "p": "(am|pm)",
    "j": r"(36[0-6]|3[0-5]\d|[1-2]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9])",
    "A": "(" + "|".join(WEEKDAYS) + ")",
    "a": "(" + "|".join(d[:3] for d in WEEKDAYS) + ")",
    "Z": "(utc|gmt)",
    "z": r"([+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|z)",
}
OUTPUT = {
    "Y": "yyyy", "y": "yy", "B": "MMMM", "b": "MMM", "m": "MM", "d": "dd",
    "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS",
}
MAX_EPOCH_SECONDS = 253402300799  # last second of year 9999

GRANULAR_TYPE = "struct<ts:timestamp_ntz,granularity:tinyint>"


def _split_format(fmt: str) -> list[tuple[str, str]]:
    """(literal, directive) pairs of a ``%`` format; the last directive may be ''."""
    parts = re.split(r"%([A-Za-z])", fmt)
    parts.append("")
    pairs = list(zip(parts[::2], parts[1::2]))
    unknown = [d for _, d in pairs if d and d not in DIRECTIVES]
    if unknown:
        raise ValueError(f"unsupported date directives {unknown} in {fmt!r}")
    return pairs


def _make(parts: dict[str, Column]) -> Column:
    """Timestamp from text parts; null where they name no real date.

    Weekdays and zones must be well formed and change nothing: times are as written.
    """
    year = parts.get("Y", F.lit("1900")).cast("int")
    if "y" in parts:
        short = parts["y"].cast("int")
        year = F.when(short < 69, short + 2000).otherwise(short + 1900)
    month = F.lit(1)
    if "m" in parts:
        month = parts["m"].cast("int")
    for key, width in (("B", None), ("b", 3)):
        if key in parts:
            names = F.array(*[F.lit(m[:width]) for m in MONTHS])
            month = F.array_position(names, F.lower(parts[key])).cast("int")
    day = F.trim(parts["d"]).cast("int") if "d" in parts else F.lit(1)
    if "j" in parts:
        first = F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1))
        date = F.date_add(first, parts["j"].cast("int") - 1)
        year, month, day = F.year(date), F.month(date), F.dayofmonth(date)
    hour = parts["H"].cast("int") if "H" in parts else F.lit(0)
    if "I" in parts:
        half = parts["I"].cast("int") % 12
        hour = F.when(F.lower(parts["p"]) == "pm", half + 12).otherwise(half) if "p" in parts else half
    minute = parts["M"].cast("int") if "M" in parts else F.lit(0)
    second = F.lit(Decimal(0))
    if "f" in parts:
        second = F.concat(parts.get("S", F.lit("0")), F.lit("."), parts["f"]).cast("decimal(16,6)")
    elif "S" in parts:
        second = parts["S"].cast("decimal(16,6)")
    made = F.try_make_timestamp_ntz(year, month, day, hour, minute, second)
    return F.when(year >= 1, made)


def _parse_one(text: Column, fmt: str) -> Column:
    pairs = _split_format(fmt)
    pattern, order = r"(?i)\A", []
    for literal, directive in pairs:
        pattern += r"\s+".join(escape_regex(piece) for piece in re.split(r"\s+", literal))
        if directive:
            pattern += DIRECTIVES[directive]
            order.append(directive)
    return with_groups(
        text, pattern + r"\z", len(order), lambda groups: _make(dict(zip(order, groups)))
    )


def granular(ts: Column, granularity: Column) -> Column:
    return let(
        ts.cast("timestamp_ntz"),
        lambda t: F.when(
            t.isNotNull(),
            F.struct(t.alias("ts"), granularity.cast("tinyint").alias("granularity")),
        ),
    )


def strptime(text: Column, formats: list[str]) -> Column:
    """First format that fits; the precision is its number of ``%`` directives."""
    tries = [granular(_parse_one(text, f), F.lit(f.count("%"))) for f in formats]
    return F.coalesce(*tries)


def serialize_granular(value: Column) -> Column:
    """ISO prefix at the value's precision."""
    out = None
    for code, fmt in ISO_FORMATS.items():
        text = F.date_format(value["ts"], fmt)
        test = F.coalesce(value["granularity"], F.lit(7)) == code
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


_ISO = (
    r"\A(\d{1,4})(?:-(1[0-2]|0?[1-9])(?:-(3[0-1]|[1-2]\d|0?[1-9])(?:T(2[0-3]|[0-1]?\d)"
    r"(?::([0-5]?\d)(?::([0-5]?\d)(?:\.(\d{1,6}))?)?)?)?)?)?\z"
)


def deserialize_granular(text: Column) -> Column:
    """ISO prefix to date and precision; unpadded parts allowed, unreal dates null."""
    def build(groups: list[Column]) -> Column:
        parts = {
            d: F.coalesce(F.nullif(group, F.lit("")), F.lit(default))
            for d, default, group in zip("mdHMSf", "110000", groups[1:])
        }
        parts["Y"] = groups[0]
        # A part is only there when all before it are, so the first gap ends the count.
        precision = F.lit(7)
        for count, group in reversed(list(enumerate(groups[1:], start=1))):
            precision = F.when(group == "", F.lit(count)).otherwise(precision)
        return granular(_make(parts), precision)

    return with_groups(text, _ISO, 7, build)


def from_datetime(ts: Column, granularity: Column | None = None) -> Column:
    """Plain timestamp to granular, full precision unless given."""
    given = F.lit(7) if granularity is None else F.coalesce(granularity, F.lit(7))
    return granular(ts, given)


def to_datetime(value: Column) -> Column:
    """Granular to plain timestamp; the precision is lost."""
    return value["ts"]


def granularity_label(code: Column) -> Column:
    pairs = [F.lit(x) for name, c in GRANULARITY.items() for x in (c, name)]
    return F.element_at(F.create_map(*pairs), code.cast("int"))


def epoch_to_utc(value: Column, resolution: float | None = None) -> Column:
    """Epoch number to UTC timestamp.

    With no resolution the value is seconds, or milliseconds where seconds would
    fall beyond year 9999.
    """
    number = value.cast("double")
    if resolution is not None:
        seconds = number * resolution
    else:
        seconds = F.when(F.abs(number) > MAX_EPOCH_SECONDS, number / 1000).otherwise(number)
    return F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")).cast("timestamp_ntz")


def epoch_to_local(value: Column, zone: str, resolution: float | None = None) -> Column:
    """Epoch number to wall-clock time in ``zone``."""
    utc = epoch_to_utc(value, resolution)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def strftime(ts: Column, fmt: str) -> Column:
    """``%`` format of a timestamp."""
    out = ""
    for literal, directive in _split_format(fmt):
        if literal:
            out += "'" + literal.replace("'", "''") + "'"
        out += OUTPUT.get(directive, "")
    return F.date_format(ts, out)

"""Records to and from their stored forms: string maps, JSON, encoded text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.dates import GRANULARITY, deserialize_granular
from gleanery.functions.enums import Enumeration

NULL = "null"
MODEL_KEY = "__model__"

GRANULARITIES = Enumeration.of("Granularity", **GRANULARITY)


@dataclass(frozen=True)
class Field:
    """A record field: its type and, for dates, the field that holds its precision."""

    name: str
    kind: str = "string"  # string, int, timestamp, granularity, decimal, date
    precision: str | None = None

    @property
    def sql_type(self) -> str:
        return {
            "timestamp": "timestamp_ntz", "granularity": "tinyint", "decimal": "decimal(38,18)",
        }.get(self.kind, self.kind)


@dataclass(frozen=True)
class Model:
    """A record type, declared by its fields. ``_`` marks a private field."""

    name: str
    fields: tuple[Field, ...]
    hooks: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def names(self, private: bool = False) -> list[str]:
        return [f.name for f in self.fields if private or not f.name.startswith("_")]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{f.name}` {f.sql_type}" for f in self.fields)


EXTRACTABLE = (
    Field("source_url"),
    Field("rank", "int"),
    Field("_cache_version"),
    Field("_last_extracted", "timestamp"),
)
ARTICLE = Model(
    "ResearchArticle",
    EXTRACTABLE
    + (
        Field("title"),
        Field("author_names"),
        Field("publication"),
        Field("volume"),
        Field("issue"),
        Field("issue_date", "timestamp", "issue_date_granularity"),
        Field("issue_date_granularity", "granularity"),
        Field("first_page"),
        Field("last_page"),
        Field("doi"),
        Field("published_timestamp", "timestamp", "granularity_published"),
        Field("granularity_published", "granularity"),
        Field("tzinfo_published"),
        Field("publisher"),
        Field("summary"),
        Field("full_text"),
    ),
)
AGENT = Model(
    "SecretAgent",
    EXTRACTABLE
    + tuple(
        Field(n)
        for n in (
            "user_agent", "browser", "browser_version", "operating_system", "hardware_type",
            "popularity",
        )
    ),
)
MODELS = {m.name: m for m in (ARTICLE, AGENT)}


def public_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp, microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def serialize_value(value: Column, kind: str) -> Column:
    """Text form of one value; null is the text ``null``."""
    if kind == "timestamp":
        text = iso_text(value)
    elif kind == "date":
        text = F.date_format(value, "yyyy-MM-dd")
    elif kind == "granularity":
        text = GRANULARITIES.qualified(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL))


def to_hash(model: Model, source: Callable[[str], Column] = F.col) -> Column:
    """Record as a string map: model tag first, null fields left out."""
    names = F.array(F.lit(MODEL_KEY), *[F.lit(f.name) for f in model.fields])
    values = F.array(
        F.lit(model.name),
        *[
            F.when(source(f.name).isNotNull(), serialize_value(source(f.name), f.kind))
            for f in model.fields
        ],
    )
    return F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())


def from_hash(hashed: Column, model: Model) -> list[Column]:
    """Typed columns of a string map; rows of another model give nulls.

    ``'null'`` and absent entries are null. A field's hook, if declared, replaces
    the conversion its type implies.
    """
    mine = F.substring_index(F.try_element_at(hashed, F.lit(MODEL_KEY)), ".", -1) == model.name
    hashed = F.when(mine, hashed)
    columns = []
    for f in model.fields:
        text = F.nullif(F.try_element_at(hashed, F.lit(f.name)), F.lit(NULL))
        if f.name in model.hooks:
            value = model.hooks[f.name](text, hashed)
        elif f.kind == "timestamp":
            value = deserialize_granular(text)["ts"]
        elif f.kind == "granularity":
            value = GRANULARITIES.from_qualified(text).cast("tinyint")
        else:
            value = text.try_cast(f.sql_type)
        columns.append(value.alias(f.name))
    return columns


def to_json(columns: list[Column]) -> Column:
    """Record as JSON with its null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def safe_encode(text: Column, charset: str) -> Column:
    """Bytes of a text; null becomes the bytes of ``null``."""
    return F.encode(F.coalesce(text, F.lit(NULL)), charset)


def safe_decode(data: Column, charset: str) -> Column:
    """Text of bytes; the bytes of ``null`` are null. Malformed bytes fail."""
    return F.when(data != F.encode(F.lit(NULL), charset), F.decode(data, charset))


def encode_hash(hashed: Column, charset: str) -> Column:
    """String map to ``array<struct<key, value>>`` of bytes."""
    return F.transform(
        F.map_entries(hashed),
        lambda e: F.struct(
            F.encode(e["key"], charset).alias("key"), F.encode(e["value"], charset).alias("value")
        ),
    )


def decode_hash(entries: Column, charset: str) -> Column:
    """Back to a string map; a model tag that does not decode is an error."""
    decoded = F.map_from_entries(
        F.transform(
            entries,
            lambda e: F.struct(
                F.decode(e["key"], charset).alias("key"), F.decode(e["value"], charset).alias("value")
            ),
        )
    )
    missing = F.raise_error(F.lit("model key is improperly encoded or missing"))
    return F.when(F.map_contains_key(decoded, F.lit(MODEL_KEY)), decoded).otherwise(
        missing.cast("map<string,string>")
    )


def rows_equal(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality over all fields."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & a.eqNullSafe(b)
    return same

"""Pointer JSON: string values that name other objects of the same payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Geo levels that need no parent in a search term.
TOP_LEVELS = ("country", "subdivision1")


def resolve_pointer(objects: DataFrame, field: str, payload: str = "payload_id",
                    path: str = "path", obj: str = "obj", name: str = "related",
                    strict: bool = False) -> DataFrame:
    """Object a JSON field points to: a string is looked up, anything else is inline.

    ``objects`` holds ``payload, path, obj`` with JSON text objects. Lookups stay
    within their payload. A missing field or object is null, or an error if
    ``strict``.
    """
    raw = F.get_json_object(obj, f"$.{field}")
    kind = json_kind(F.col(obj), field)
    with_raw = objects.withColumn("_raw", raw).withColumn("_kind", kind)
    pointer = F.when(F.col("_kind") == "STRING", F.col("_raw"))
    targets = objects.select(payload, F.col(path).alias("_pointer"), F.col(obj).alias("_target"))
    joined = with_raw.withColumn("_pointer", pointer).join(
        targets, [payload, "_pointer"], "left"
    )
    found = F.when(F.col("_kind") == "STRING", F.col("_target")).otherwise(F.col("_raw"))
    if strict:
        lost = (F.col("_kind") == "STRING") & F.col("_target").isNull()
        reason = F.concat(F.lit(f"no object for {field} of "), F.col(path))
        found = F.when(F.col("_kind").isNull() | lost, F.raise_error(reason).cast("string")).otherwise(found)
    return joined.withColumn(name, found).drop("_raw", "_kind", "_pointer", "_target")


def resolve_pointers(objects: DataFrame, fields: list[str], payload: str = "payload_id",
                     path: str = "path", obj: str = "obj") -> DataFrame:
    """Objects that several fields point to, as ``payload, path, field, related`` rows, by one join.

    As ``resolve_pointer`` without ``strict``: every object has a row for each field.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.get_json_object(obj, f"$.{f}").alias("raw"),
                json_kind(F.col(obj), f).alias("kind"),
            )
            for f in fields
        ]
    )
    pointing = objects.select(payload, path, F.explode(entries).alias("_e")).withColumn(
        "_pointer", F.when(F.col("_e.kind") == "STRING", F.col("_e.raw"))
    )
    targets = objects.select(payload, F.col(path).alias("_pointer"), F.col(obj).alias("_target"))
    found = F.when(F.col("_e.kind") == "STRING", F.col("_target")).otherwise(F.col("_e.raw"))
    return pointing.join(targets, [payload, "_pointer"], "left").select(
        payload, path, F.col("_e.field").alias("field"), found.alias("related")
    )


def json_kind(obj: Column, field: str) -> Column:
    """JSON type of a field: STRING, ARRAY, OBJECT, NULL, ...; null when absent."""
    schema = F.schema_of_variant(F.try_variant_get(F.try_parse_json(obj), f"$.{field}", "variant"))
    return F.regexp_replace(schema, "^(ARRAY|OBJECT|VOID)[\\s\\S]*$", "$1")


def resolve_pointer_list(objects: DataFrame, field: str, payload: str = "payload_id",
                         path: str = "path", obj: str = "obj", strict: bool = False) -> DataFrame:
    """Objects a list of pointers names, as ``payload, path, pos, related`` rows.

    The list is exploded, so it may be long; order is kept in ``pos``. Missing
    targets are left out, or an error if ``strict``.
    """
    pointers = F.from_json(F.get_json_object(obj, f"$.{field}"), "array<string>")
    exploded = objects.select(payload, path, F.posexplode(pointers).alias("pos", "_pointer"))
    targets = objects.select(payload, F.col(path).alias("_pointer"), F.col(obj).alias("related"))
    joined = exploded.join(targets, [payload, "_pointer"], "left" if strict else "inner")
    if strict:
        reason = F.concat(F.lit("no object for "), F.col("_pointer"))
        joined = joined.withColumn("related", F.coalesce("related", F.raise_error(reason).cast("string")))
    return joined.select(payload, path, "pos", "related")


def names_of(name: Column, abbrev: Column) -> Column:
    """Name, and abbreviation where there is one."""
    return F.when(name.isNotNull(), F.array_compact(F.array(name, F.nullif(abbrev, F.lit("")))))


def geo_terms(terms: Column, parent_terms: Column, top_level: Column) -> Column:
    """Geo search terms: paired with every parent term unless the place is top level.

    Both lists hold a name and at most an abbreviation, so the pairing stays
    within the row and within four terms.
    """
    pairs = F.flatten(
        F.transform(
            terms, lambda t: F.transform(parent_terms, lambda p: F.concat_ws(", ", t, p))
        )
    )
    alone = F.coalesce(top_level.isin(*TOP_LEVELS), F.lit(False)) | parent_terms.isNull()
    return F.when(alone, terms).otherwise(pairs)


def first_key(obj: Column) -> Column:
    """First key of a JSON object."""
    return F.get(F.json_object_keys(obj), F.lit(0))


def search_terms(payloads: DataFrame, body: str = "body", payload: str = "payload_id") -> DataFrame:
    """Search data of each payload: problem, org and geo terms, in that order.

    Pointers stay within their payload, and a payload is one row, so every hop is
    a look-up in the payload's own map: nothing is shuffled.
    """
    def hop(df: DataFrame, base: str, hops: dict[str, str]) -> DataFrame:
        return df.withColumns(
            {name: _related(F.col(base), field, F.col("_objects")) for field, name in hops.items()}
        )

    df = payloads.withColumn("_objects", F.from_json(body, "map<string,string>"))
    df = df.select(payload, "_objects", F.col(body).alias("_base"))
    df = hop(df, "_base", {"root": "_community"})
    df = hop(df, "_community", {"problem": "_problem", "org": "_org", "geo": "_geo"})
    df = hop(df, "_geo", {"levels": "_levels", "path_parent": "_parent"})
    get = lambda c, f: F.get_json_object(c, f"$.{f}")
    names = lambda c: names_of(get(c, "name"), get(c, "abbrev"))
    geo = geo_terms(names("_geo"), names("_parent"), first_key(F.col("_levels")))
    return df.select(
        payload,
        F.array(
            topic("problem", names_of(get("_problem", "name"), F.lit(None))),
            topic("org", names_of(get("_org", "name"), F.lit(None))),
            topic("geo", geo),
        ).alias("search_data"),
    )


def _related(obj: Column, field: str, objects: Column) -> Column:
    """Object a field points to within its payload's map of objects."""
    raw = F.get_json_object(obj, f"$.{field}")
    pointed = F.try_element_at(objects, raw)
    return F.when(json_kind(obj, field) == "STRING", pointed).otherwise(raw)


def topic(name: str, terms: Column) -> Column:
    return F.struct(F.lit(name).alias("topic"), terms.alias("terms"))


__all__ = [
    "first_key", "geo_terms", "json_kind", "names_of", "resolve_pointer",
    "resolve_pointer_list", "resolve_pointers", "search_terms", "topic",
]

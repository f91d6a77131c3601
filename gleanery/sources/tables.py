"""Files in and out: delimited tables, JSON dictionaries, payloads, site definitions."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.records import AGENT, Model
from gleanery.session import self_contained

self_contained(__name__)

CSV_FORMAT = {"sep": "|", "quote": '"', "escape": '"', "header": True}

# The user agent to fall back to.
DEFAULT_AGENT = {
    "source_url": "https://developers.whatismybrowser.com/useragents/parse/627832-chrome-windows-blink",
    "user_agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/60.0.3112.113 Safari/537.36",
    "browser": "Chrome",
    "browser_version": "60.0.3112.113",
    "operating_system": "Windows",
    "hardware_type": "Computer",
    "popularity": "Very common",
}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited file with a header, typed by the model and checked against it."""
    return (
        spark.read.schema(schema)
        .options(**CSV_FORMAT, enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    """Write a delimited table; a table without columns or rows is refused."""
    if not df.columns:
        raise ValueError("headers are missing")
    if df.isEmpty():
        raise ValueError("no data to save")
    df.write.options(**CSV_FORMAT, emptyValue="").csv(path)


def read_or_default(spark: SparkSession, path: str, schema: str, default: dict) -> DataFrame:
    """A table, or one default row where nothing is stored at the path.

    An existing but empty table stays empty.
    """
    try:
        return read_table(spark, path, schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        row = spark.createDataFrame([Row(**{k: v for k, v in default.items()})])
        empty = spark.createDataFrame([], schema)
        return empty.unionByName(row, allowMissingColumns=True)


def public_schema(model: Model = AGENT) -> str:
    return ", ".join(f"{f.name} {f.sql_type}" for f in model.fields if not f.name.startswith("_"))


def read_dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def remove_dictionary(spark: SparkSession, path: str, schema: str) -> None:
    """Empty a stored dictionary."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def payload_entries(payloads: DataFrame, body: str = "body", key: str = "payload_id") -> DataFrame:
    """Entries of JSON payload objects, one row per path, in payload order."""
    names = F.json_object_keys(F.col(body))
    # A map read keeps every entry's value as raw JSON text.
    values = F.from_json(F.col(body), "map<string,string>")
    return payloads.select(key, F.posexplode(names).alias("pos", "path"), values.alias("_v")).select(
        key, "pos", "path", F.try_element_at("_v", F.col("path")).alias("obj")
    )


# --- site definitions ---------------------------------------------------------


def _parse_definition(raw: str | None) -> str | None:
    """A definition as JSON, null unless it is a mapping.

    Without a YAML reader a file that is not JSON is an error, not a broken site.
    """
    if raw is None:
        return None
    try:
        parsed = json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("a site definition is not JSON and PyYAML is not installed here") from missing
        try:
            parsed = yaml.safe_load(raw)
        except yaml.YAMLError:
            return None
    return json.dumps(_plain(parsed), default=str) if isinstance(parsed, dict) else None


def _plain(value):
    """YAML's infinities as text, which JSON cannot state otherwise."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity")
    return value


@F.pandas_udf(T.StringType())
def _definition_json(text: pd.Series) -> pd.Series:
    return text.map(_parse_definition)


def read_definitions(spark: SparkSession, root: str, file_name: str = "multi.yaml") -> DataFrame:
    """Every site definition below ``root``: its directory and its content as JSON.

    A definition that cannot be read has null JSON.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    directory = F.substring_index(folder, base + "/", -1)
    return files.select(directory.alias("directory"), _definition_json("value").alias("definition"))


def enabled_definitions(definitions: DataFrame) -> DataFrame:
    """Catalog of usable definitions: readable and not switched off."""
    flag = F.coalesce(F.get_json_object("definition", "$.is_enabled"), F.lit("true"))
    sources = F.coalesce(F.get_json_object("definition", "$.extract_sources"), F.lit("true"))
    return definitions.filter(F.col("definition").isNotNull()).select(
        "directory",
        (flag == "true").alias("is_enabled"),
        F.get_json_object("definition", "$.cache_version").alias("cache_version"),
        F.coalesce(
            F.get_json_object("definition", "$.freshness_threshold").try_cast("double"), F.lit(30.0)
        ).alias("freshness_days"),
        (sources == "true").alias("extract_sources"),
        F.json_object_keys("definition").alias("settings"),
    ).filter("is_enabled")


def definition_column(**settings: Column) -> Column:
    """A definition text built from columns, for catalogs kept as data."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in settings.items()]))

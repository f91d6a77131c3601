"""Items: one row per matched element, ranked by page and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.fields import Context, Value, compile_field, enlist, needs_page


def explode_items(pages: DataFrame, definition, nodes: str = "nodes",
                  keep_page: bool = False) -> DataFrame:
    """One row per item element, with its 1-based ``index``; no match, no row.

    An item carries only its own subtree. The whole page stays with it only on
    request, for fields that look beyond their item.
    """
    ctx = Context(F.col(nodes), F.col(nodes), {})
    found: Value = compile_field(definition, ctx)
    if found.kind != "element":
        raise ValueError("items must be elements")
    others = [c for c in pages.columns if c != nodes or keep_page]
    items = pages.select(*others, F.posexplode(found.values).alias("index", "element"))
    return items.withColumn("index", F.col("index") + 1)


def rank_items(page: Column, page_size: Column | int | None, index: Column) -> Column:
    """Rank over all pages of a search; without a page size the index alone."""
    size = F.lit(0 if page_size is None else page_size) if not isinstance(page_size, Column) else page_size
    return (page - 1) * size + index


def valid_items(items: DataFrame) -> DataFrame:
    """Items that know their source."""
    return items.filter("source_url is not null and source_url <> ''")


def limit_pages(pages: DataFrame, page: str, limit: int) -> DataFrame:
    """Pages up to a site's page limit."""
    return pages.filter(F.col(page) <= limit)


def page_value(definition, nodes: str = "nodes") -> Column:
    """A single value read from the whole page."""
    return compile_field(definition, Context(F.col(nodes), F.col(nodes), {})).scalar()


def any_needs_page(content: dict) -> bool:
    return any(needs_page(definition) for definition in content.values())


__all__ = [
    "any_needs_page", "enlist", "explode_items", "limit_pages", "page_value", "rank_items",
    "valid_items",
]

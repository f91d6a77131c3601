"""Whole extractions: stored pages to items, items overlaid by source pages.

Result pages are one row per address; ``latest_pages`` makes them so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.records import Model
from gleanery.functions.urls import normalize_url, resolve_link
from gleanery.operators.assemble import keep_last, overlay
from gleanery.operators.crawl import Dwell
from gleanery.operators.fields import derive_fields
from gleanery.operators.html import with_nodes
from gleanery.operators.items import (
    any_needs_page, explode_items, limit_pages, page_value, rank_items, valid_items,
)
from gleanery.operators.status import FRESH_DAYS
from gleanery.plans.search import UrlTemplate
from gleanery.session import cut_lineage

DEFAULT_PAGES = 10


@dataclass(frozen=True)
class Provider:
    """A site's definition. ``source`` sites have no items, URL or pagination."""

    directory: str
    content: dict
    items: dict | list | None = None
    url: UrlTemplate | None = None
    is_enabled: bool = True
    cache_version: str | None = None
    freshness_days: float = FRESH_DAYS["multi"]
    extract_sources: bool = True
    pages: int = 1
    page_size: int | None = None
    next_page: dict | list | None = None
    dwell: Dwell = field(default_factory=Dwell)
    ignored: tuple[str, ...] = ()

    @classmethod
    def multi(cls, directory: str, config: dict) -> Provider:
        paging = config.get("pagination") or {}
        if paging:
            ways = [k for k in ("next_page_click", "next_page_url") if paging.get(k)]
            if len(ways) != 1:
                raise ValueError("pagination needs either next_page_click or next_page_url")
        return cls(
            directory,
            content=config["content"],
            items=config["items"],
            url=UrlTemplate.from_config(config["url"]),
            is_enabled=config.get("is_enabled", True),
            cache_version=config.get("cache_version"),
            freshness_days=float(config.get("freshness_threshold", FRESH_DAYS["multi"])),
            extract_sources=config.get("extract_sources", True),
            pages=int(paging.get("pages", DEFAULT_PAGES)) if paging else 1,
            page_size=paging["page_size"] if paging else None,
            next_page=paging.get("next_page_url"),
            dwell=Dwell.from_config(config.get("delay")),
            ignored=tuple(sorted(set(config) - KNOWN_KEYS)),
        )

    @classmethod
    def source(cls, directory: str, config: dict) -> Provider:
        return cls(
            directory,
            content=config["content"],
            is_enabled=config.get("is_enabled", True),
            cache_version=config.get("cache_version"),
            freshness_days=float(config.get("freshness_threshold", FRESH_DAYS["source"])),
            dwell=Dwell.from_config(config.get("delay")),
            ignored=tuple(sorted(set(config) - KNOWN_KEYS)),
        )


# The settings a site definition may hold.
KNOWN_KEYS = frozenset(
    "page_type is_enabled cache_version freshness_threshold extract_sources wait url pagination "
    "delay items content".split()
)


def items_of(parsed: DataFrame, provider: Provider, model: Model) -> DataFrame:
    """Ranked items of parsed result pages (``nodes``, ``page``), also those without a source, with their ``_errors``."""
    keep_page = any_needs_page(provider.content)
    items = explode_items(limit_pages(parsed, "page", provider.pages), provider.items, keep_page=keep_page)
    items = items.withColumn("rank", rank_items(F.col("page"), provider.page_size, F.col("index")))
    derived = derive_fields(items, model, provider.content, page="nodes" if keep_page else None)
    return derived.drop("element", "nodes")


def extract_items(pages: DataFrame, provider: Provider, model: Model) -> DataFrame:
    """Valid, ranked items of result pages (``html``, ``page`` and any key columns)."""
    return valid_items(items_of(with_nodes(limit_pages(pages, "page", provider.pages)), provider, model))


def sources_of(parsed: DataFrame, provider: Provider, model: Model, url: str = "url") -> DataFrame:
    """Fields of parsed source pages; the page's normalised address is their source URL."""
    ready = parsed.withColumns({"source_url": normalize_url(F.col(url)), "rank": F.lit(None).cast("int")})
    return derive_fields(ready, model, provider.content, "nodes", "nodes", None).drop("nodes")


def extract_sources(pages: DataFrame, provider: Provider, model: Model, url: str = "url") -> DataFrame:
    """Fields of source pages (``html``)."""
    return sources_of(with_nodes(pages), provider, model, url)


def combine(items: DataFrame, sources: DataFrame, model: Model, page_url: str = "url",
            within: tuple[str, ...] = ()) -> DataFrame:
    """Last item per source URL, overlaid by its source page's fields.

    ``within`` names the columns of one extraction (its search and provider): a link found
    by several of them is an item of each. Equal ranks are settled by the page's address and the title.
    """
    absolute = items.withColumn(
        "source_url", normalize_url(resolve_link(F.col("source_url"), F.col(page_url)))
    )
    ties = [c for c in ("page", page_url, "index", "title") if c in absolute.columns]
    kept = keep_last(absolute, [*within, "source_url"], ["rank", *ties])
    fields = [n for n in model.names() if n not in ("source_url", "rank")]
    return overlay(kept, sources, fields, normalized=True, order=[page_url])


def latest_pages(pages: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """The last stored copy of each page."""
    return keep_last(pages, url, order, "_first").drop("_first")


def page_links(pages: DataFrame, provider: Provider, url: str = "url") -> DataFrame:
    """``url, next_url`` of each page that has a next page."""
    found = with_nodes(pages).select(url, page_value(provider.next_page).alias("_next"))
    return found.select(
        F.col(url).alias("url"), resolve_link(F.col("_next"), F.col(url)).alias("next_url")
    ).filter("next_url is not null")


def follow_pages(starts: DataFrame, links: DataFrame, limit: int, url: str = "url", within: tuple[str, ...] = ()) -> DataFrame:
    """Pages reached from each start by next-page links, with their page number.

    A trail ends at a page it has met before. Links are doubled: after ``k`` rounds a link leads 2^k pages
    on and every trail is known for its first 2^k pages, so a chain of a thousand pages takes ten rounds. A page
    keeps the smallest number at which its trail meets it, which ends loops of any length. Rounds stop when no
    trail has grown. ``within`` names columns of both sides that tell separate sets of links apart. A start
    that very many searches share is followed once.
    """
    keys = list(within)
    # Copies of a page are one link, or every round would multiply by them.
    jumps = cut_lineage(links.groupBy(*keys, F.col("url").alias("_at")).agg(F.max("next_url").alias("_to")))
    first = starts.select(*keys, F.col(url).alias("_start")).distinct()
    reached = cut_lineage(first.select("*", F.col("_start").alias("_at"), F.lit(0).cast("bigint").alias("_hops")))
    known, span = reached.count(), 1
    while span < limit:
        further = reached.join(jumps, [*keys, "_at"]).select(
            *keys, "_start", F.col("_to").alias("_at"), (F.col("_hops") + span).alias("_hops")
        )
        longer = reached.unionByName(further.filter(F.col("_hops") < limit))
        reached, span = longer.groupBy(*keys, "_start", "_at").agg(F.min("_hops").alias("_hops")), 2 * span
        if span >= limit:  # the last round is read once only
            break
        reached = cut_lineage(reached)
        before, known = known, reached.count()
        if known == before:
            break
        onward = jumps.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_on"))
        jumps = cut_lineage(jumps.join(onward, [*keys, "_to"]).select(*keys, "_at", F.col("_on").alias("_to")))
    return starts.withColumnRenamed(url, "_start").join(reached, [*keys, "_start"]).select(
        *[c for c in starts.columns if c != url],
        (F.col("_hops") + 1).cast("int").alias("page"),
        F.col("_at").alias(url),
    )


def unknown_keys(given: Column, known: list[str]) -> Column:
    """Settings a definition holds that nothing reads."""
    return F.array_sort(F.array_except(given, F.array(*[F.lit(k) for k in sorted(known)])))

"""From searches to stored answers: what is stale is extracted, overlaid and written, for all searches at once.

Site definitions are read from files (``multi.yaml`` for a site's result pages, ``source.yaml``
for its source pages). Searches meet every enabled site; pairs with reusable content drop out.
An address that many searches share is followed and extracted once, and its items then meet their
searches. Sources are routed to the deepest directory that defines them; those whose stored content is
fresh by that definition are not parsed again, and what is stored of them is laid over the items.

However many sites there are, each table of pages is read once and each wanted page parsed once: pages meet the
definitions that want them, are parsed, and are written by definition, so that each definition then reads its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.records import Model
from gleanery.functions.urls import normalize_url, resolve_link
from gleanery.operators.assemble import route
from gleanery.operators.html import with_nodes
from gleanery.operators.items import page_value, valid_items
from gleanery.operators.status import COMPLETED, EMPTY, FAILURE, INITIATED, PRELIMINARY, outstanding, reusable, reusable_source
from gleanery.plans.extraction import Provider, combine, follow_pages, items_of, sources_of
from gleanery.plans.search import search_plan
from gleanery.sources.store import info_updates, merge_fields, prepare_content, rank_index
from gleanery.sources.tables import read_definitions
from gleanery.session import cut_lineage, dealt, scratch_path

#: Site definitions that one driver holds.
MOST_SITES = 10_000
#: Definitions that one job extracts by, so that plans stay small however many sites there are.
SITES_A_JOB = 32


@dataclass(frozen=True)
class Sites:
    """The providers of a catalog by directory: those that are searched, and those of source pages."""

    multi: dict[str, Provider]
    source: dict[str, Provider]

    def catalog(self, spark: SparkSession) -> DataFrame:
        """Directories as ``route`` needs them, with all parents."""
        names = {"/".join(d.split("/")[:i + 1]) for d in (*self.multi, *self.source) for i in range(d.count("/") + 1)}
        rows = [(n, n in self.source, n in self.source and self.source[n].is_enabled) for n in sorted(names)]
        return spark.createDataFrame(rows, "directory string, has_source boolean, is_enabled boolean")


def sites_of(multi: DataFrame, source: DataFrame) -> Sites:
    """Providers from tables of definitions (``directory``, ``definition`` as JSON); null definitions are left out."""
    found = []
    for rows, build in ((multi, Provider.multi), (source, Provider.source)):
        held = rows.filter("definition is not null").limit(MOST_SITES + 1).collect()
        if len(held) > MOST_SITES:
            raise ValueError(f"more than {MOST_SITES} site definitions")
        found.append({r["directory"]: build(r["directory"], json.loads(r["definition"])) for r in held})
    return Sites(*found)


def load_sites(spark: SparkSession, root: str, multi: str = "multi.yaml", source: str = "source.yaml") -> Sites:
    """Providers from the definition files below ``root``; files that are no definition are left out."""
    return sites_of(read_definitions(spark, root, multi), read_definitions(spark, root, source))


@dataclass(frozen=True)
class Refreshed:
    """What a refresh writes, and what went wrong.

    ``content`` by source URL, ``index`` by search and provider, ``info`` with the status of each
    pair, and ``errors`` of fields by provider and page.
    """

    content: DataFrame
    index: DataFrame
    info: DataFrame
    errors: DataFrame


def by_provider(providers: dict[str, Provider], value, kind: str, name: str = "provider") -> Column:
    """A value of the row's provider."""
    if not providers:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x).cast(t) for d, p in sorted(providers.items()) for x, t in ((d, "string"), (value(p), kind))]
    return F.try_element_at(F.create_map(*pairs), F.col(name))


def stale(plan: DataFrame, info: DataFrame, providers: dict[str, Provider], search: str, now: Column) -> DataFrame:
    """The planned pairs whose stored extraction cannot be used, by each provider's version and freshness."""
    reuse = reusable(
        F.col("status"), F.col("last_extracted"), F.col("cache_version"), now,
        by_provider(providers, lambda p: p.freshness_days, "double"),
        by_provider(providers, lambda p: p.cache_version, "string"),
    )
    return outstanding(plan, info, [search, "provider"], reuse)


def next_links(pages: DataFrame, definitions: list) -> DataFrame:
    """``way, url, next_url`` for each of several next-page definitions: one parse of the pages for all of them."""
    found = F.array(*(F.struct(F.lit(i).alias("way"), page_value(d).alias("to")) for i, d in enumerate(definitions)))
    each = with_nodes(pages.select("url", "html")).select("url", F.explode(found).alias("_n"))
    links = each.select("_n.way", "url", resolve_link(F.col("_n.to"), F.col("url")).alias("next_url"))
    return links.filter("next_url is not null")


def page_chains(work: DataFrame, providers: dict[str, Provider], pages: DataFrame) -> DataFrame:
    """``provider, _first, page, url``: the result pages of every start address, for all sites at once."""
    starts = work.select("provider", "url", F.col("url").alias("_first")).distinct()
    ways, way_of = [], {}
    for name, site in sorted(providers.items()):
        if site.next_page is not None and site.pages > 1:
            if site.next_page not in ways:
                ways.append(site.next_page)
            way_of[name] = ways.index(site.next_page)
    single = starts.filter(~F.col("provider").isin(list(way_of))).select("provider", "_first", F.lit(1).alias("page"), "url")
    if not ways:
        return single
    pairs = [F.lit(x) for item in way_of.items() for x in item]
    paged = starts.filter(F.col("provider").isin(list(way_of)))
    paged = paged.withColumn("way", F.try_element_at(F.create_map(*pairs), F.col("provider")))
    most = max(providers[name].pages for name in way_of)
    chains = follow_pages(paged, next_links(pages, ways), most, within=("way",)).select("provider", "_first", "page", "url")
    limit = by_provider(providers, lambda p: p.pages, "bigint")
    return single.unionByName(chains.filter(F.col("page") <= limit))


def parsed_for(wanted: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of the wanted pages: ``keys``, ``url``, ``nodes``, one row for each (``keys``, ``url``) whose page is stored.

    ``keys`` starts with the name of the definition. Each stored page is read and parsed once; the nodes are written in
    a folder for each definition. A page is wanted at few places, by few definitions.
    """
    places = wanted.groupBy("url").agg(F.collect_set(F.struct(*keys)).alias("_places"))
    chosen = pages.select("url", "html").join(places, "url").withColumn("_for", F.col("_places")[0][keys[0]])
    # Pages of one definition come together, so that a folder gets few files; large definitions are split.
    parsed = with_nodes(chosen.hint("rebalance", "_for")).select("url", "nodes", F.inline("_places"))
    path = scratch_path(pages.sparkSession, "parsed")
    parsed.write.partitionBy(keys[0]).parquet(path)
    return pages.sparkSession.read.schema(parsed.schema).parquet(path)


def extracted_by_each(providers: dict[str, Provider], parsed: DataFrame, name: str, build) -> DataFrame:
    """What every definition makes of its own folder, some definitions a job."""
    spark = parsed.sparkSession
    # Also without definitions the columns are those of the model.
    frames = {d: build(parsed.filter(F.col(name) == d), p) for d, p in sorted(providers.items())}
    frames = frames or {"": build(parsed.filter(F.lit(False)), Provider("", content={}, items={"tag_name": "li"}))}
    path, names = scratch_path(spark, "extracted"), list(frames)
    schema = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(frames.values())[:SITES_A_JOB]).schema
    for begin in range(0, len(names), SITES_A_JOB):
        some = [frames[n] for n in names[begin:begin + SITES_A_JOB]]
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def found_items(chains: DataFrame, providers: dict[str, Provider], parsed: DataFrame, model: Model) -> DataFrame:
    """Items of all result pages, each page's once; also items without a source address."""
    items = extracted_by_each(providers, parsed, "provider", lambda rows, site: items_of(rows, site, model))
    return items.withColumn("source_url", normalize_url(resolve_link(F.col("source_url"), F.col("url"))))


def routed_sources(urls: DataFrame, sites: Sites, stored: DataFrame | None, now: Column) -> DataFrame:
    """``source_url, directory, fresh``: the enabled definition of each address, and whether its stored content will do."""
    routed = route(urls.select("source_url").distinct(), sites.catalog(urls.sparkSession), "source_url", "source_url")
    routed = routed.filter("is_enabled").select("source_url", "directory")
    if stored is None:
        return routed.withColumn("fresh", F.lit(False))
    known = stored.select("source_url", "_last_extracted", "_cache_version")
    fresh = reusable_source(
        F.col("_last_extracted"), F.col("_cache_version"), now,
        by_provider(sites.source, lambda p: p.cache_version, "string", "directory"),
        by_provider(sites.source, lambda p: p.freshness_days, "double", "directory"),
    )
    return routed.join(known, "source_url", "left").select("source_url", "directory", fresh.alias("fresh"))


def refresh(searches: DataFrame, sites: Sites, topics: list[str], info: DataFrame, pages: DataFrame,
            source_pages: DataFrame, model: Model, now: Column, search: str = "search_key",
            stored: DataFrame | None = None) -> Refreshed:
    """Extract what is stale and state what is to be stored.

    ``searches`` holds ``search`` and ``search_data``; ``pages`` and ``source_pages`` hold one row for each
    address (``url``, ``html``); ``stored`` is the content known before, one row for each ``source_url`` with
    ``_cache_version`` and ``_last_extracted``. A link that several searches find is an item of each and one content row.

    Status of a pair: initiated, without a time, while its first page is not there; empty if its pages hold no
    items; a failure if none of the items has an address; preliminary while a source page that its site asks
    for is missing; else completed.
    """
    providers = {d: p for d, p in sites.multi.items() if p.is_enabled and p.url is not None}
    fields = [n for n in model.names() if n not in ("source_url", "rank")]
    version = by_provider(providers, lambda p: p.cache_version, "string")
    looked_up = F.coalesce(by_provider(providers, lambda p: p.extract_sources, "boolean"), F.lit(False))

    plan = search_plan(searches, {d: p.url for d, p in providers.items()}, topics).drop("search_data")
    work = cut_lineage(stale(plan, info, providers, search, now))
    chains = cut_lineage(page_chains(work, providers, pages))
    parsed = parsed_for(chains, pages, ["provider", "page"])
    items = found_items(chains, providers, parsed, model)
    pairs = work.select(search, "provider", F.col("url").alias("_first"))

    # Source pages: those of items whose site asks for them, unless what is stored is fresh.
    valid = valid_items(items)
    routed = cut_lineage(routed_sources(valid.filter(looked_up), sites, stored, now))
    at_source = source_pages.withColumn("source_url", normalize_url(F.col("url")))
    wanted = at_source.select("url", "source_url").join(routed.filter(~F.col("fresh")), "source_url").select("url", "directory")
    source_rows = extracted_by_each(
        sites.source, parsed_for(wanted, source_pages, ["directory"]), "directory", lambda rows, site: sources_of(rows, site, model)
    )
    sources = source_rows.select("source_url", "url", *fields)
    if stored is not None:
        kept = stored.join(routed.filter("fresh"), "source_url", "left_semi")
        sources = sources.unionByName(
            kept.select("source_url", F.col("source_url").alias("url"), *[f for f in fields if f in kept.columns]),
            allowMissingColumns=True,
        )

    found = cut_lineage(pairs.join(chains, ["provider", "_first"]).join(items, ["provider", "url", "page"]).drop("_errors", "_first"))
    # Many searches find the same items, so both files hold far more rows than their bytes tell.
    results = dealt(valid_items(found))
    own = combine(results.filter(~looked_up), sources.limit(0), model, within=(search, "provider"))
    overlaid = combine(results.filter(looked_up), sources, model, within=(search, "provider"))
    results = dealt(cut_lineage(own.unionByName(overlaid)))

    # A source page's content carries its own definition's version; a stored one that was used stays as it is.
    read = source_rows.select("source_url", "directory").groupBy("source_url").agg(F.max("directory").alias("_directory"))
    state = routed.select("source_url", F.col("fresh").alias("_fresh")).join(read, "source_url", "left")
    told = results.join(state, "source_url", "left")
    from_source = looked_up & F.col("_directory").isNotNull()
    source_version = by_provider(sites.source, lambda p: p.cache_version, "string", "_directory")
    writes = told.filter(~(looked_up & F.coalesce("_fresh", F.lit(False))))
    stamped = prepare_content(
        writes.withColumn("_provider", F.col("provider")), F.when(from_source, source_version).otherwise(version), now
    )
    # Where extractions disagree on an address, the provider whose name sorts last wins, then the search that does.
    content = merge_fields(
        stamped.select("source_url", *fields, "_cache_version", "_last_extracted", "_provider", F.col(search).alias("_search")),
        ["source_url"], ["_provider", "_search"],
    ).drop("_provider", "_search")
    index = rank_index(results, [search, "provider"], "source_url", "rank", ["position"])

    arrived = parsed.filter("page = 1").select("provider", F.col("url").alias("_first")).distinct().withColumn("_arrived", F.lit(True))
    missing = looked_up & F.col("_fresh").eqNullSafe(False) & F.col("_directory").isNull()
    counts = told.groupBy(search, "provider").agg(F.count(F.lit(1)).alias("_valid"), F.count_if(missing).alias("_missing"))
    seen = found.groupBy(search, "provider").agg(F.count(F.lit(1)).alias("_seen"))
    status = (
        F.when(F.col("_arrived").isNull(), INITIATED)
        .when(F.col("_seen").isNull(), EMPTY)
        .when(F.col("_valid").isNull(), FAILURE)
        .when(F.col("_missing") > 0, PRELIMINARY)
        .otherwise(COMPLETED)
    )
    each = pairs.join(arrived, ["provider", "_first"], "left")
    each = each.join(seen, [search, "provider"], "left").join(counts, [search, "provider"], "left")
    done = info_updates(
        each.select(search, "provider", status.alias("status"), now.alias("at"), version.alias("version")), "status", "at", "version"
    ).drop("at", "version")

    wrong = lambda rows, name: rows.select(
        F.col(name).alias("provider"), "url", "source_url", F.inline("_errors")
    )
    errors = wrong(items, "provider").unionByName(wrong(source_rows, "directory"))
    return Refreshed(content, index.select(search, "provider", "source_url", "rank"), done, errors)

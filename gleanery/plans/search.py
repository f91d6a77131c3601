"""Search URLs: a site's URL template compiled to a column over search data.

``search_data`` is ``array<struct<topic, terms array<string>>>``: topics are
ANDed in order, the terms of a topic ORed, null terms mean the topic is unset.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import url_quote

TOKEN = re.compile(r"\{([^{}]*)\}")
SERIES = ("TOPIC", "TERM")


class UrlError(ValueError):
    """A URL template that cannot be compiled."""


@dataclass(frozen=True)
class UrlTemplate:
    """A template and the named definitions its tokens may refer to."""

    template: str
    definitions: dict = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: str | dict) -> UrlTemplate:
        if isinstance(config, str):
            return cls(config)
        if "url_template" not in config:
            raise UrlError("url_template is missing")
        definitions = {k: v for k, v in config.items() if k != "url_template"}
        for name, value in definitions.items():
            if isinstance(value, str):
                continue
            if not isinstance(value, dict):
                raise UrlError(f"{name} must be a text or a series")
            lacking = [k for k in ("series", "templates", "delimiter") if k not in value]
            if lacking:
                raise UrlError(f"{name} lacks {lacking}")
            if value["series"] not in SERIES:
                raise UrlError(f"{name}: unknown series {value['series']!r}")
        return cls(config["url_template"], definitions)

    def column(self, search_data: Column, topics: list[str]) -> Column:
        """URL of each search; null where a needed topic is unset.

        ``topics`` names the topics of the search data in order, so tokens are
        checked here, on the driver, before any row is read.
        """
        if not self.definitions and "{" not in self.template:
            return F.lit(self.template)
        encoded = F.transform(
            search_data,
            lambda t: F.struct(
                t["topic"].alias("topic"), F.transform(t["terms"], url_quote).alias("terms")
            ),
        )
        return _Compiler(self.definitions, encoded, topics).clause(
            self.template, None, None, F.lit(1)
        )


@dataclass(frozen=True)
class _Compiler:
    definitions: dict
    data: Column
    topics: list[str]

    def terms(self, token: str, current: Column | None) -> Column:
        if token in self.topics:
            entry = F.get(F.filter(self.data, lambda t: t["topic"] == token), F.lit(0))
            return entry["terms"]
        if current is None:
            raise UrlError("{term} used outside a series")
        return current

    def clause(self, template: str, current: Column | None, at: Column | None,
               index: Column) -> Column:
        """Template with its tokens replaced; null if a term is unset.

        ``current`` holds the terms of the topic in turn and ``at`` the place of
        the term in turn, if any.
        """
        pieces: list[Column] = []
        parts = TOKEN.split(template)
        for literal, token in zip(parts[::2], parts[1::2] + [None]):
            if literal:
                pieces.append(F.lit(literal))
            if token is None:
                continue
            if token == "index":
                pieces.append(index.cast("string"))
            elif token in self.topics or token == "term":
                terms = self.terms(token, current)
                pieces.append(F.get(terms, F.lit(0) if at is None else at))
            elif token in self.definitions:
                value = self.definitions[token]
                if isinstance(value, str):
                    pieces.append(self.clause(value, current, at, index))
                elif value["series"] == "TOPIC":
                    pieces.append(self.topic_series(value))
                else:
                    pieces.append(self.term_series(value, current))
            else:
                raise UrlError(f"unknown token {token!r}")
        return F.concat(*pieces) if pieces else F.lit("")

    def _by_place(self, templates: list[str], place: Column, build) -> Column:
        """The clause of the template for a place; the last template repeats."""
        result = None
        for i, template in enumerate(templates[:-1]):
            test, clause = place == i, build(template)
            result = F.when(test, clause) if result is None else result.when(test, clause)
        last = build(templates[-1])
        return last if result is None else result.otherwise(last)

    def topic_series(self, series: dict) -> Column:
        """One clause per set topic; numbering skips unset topics, templates do not."""
        templates = series["templates"]
        if len(templates) > len(self.topics):
            raise UrlError("more templates than topics")
        placed = F.transform(
            self.data, lambda t, i: F.struct(i.alias("place"), t["terms"].alias("terms"))
        )
        build = lambda p, index: self._by_place(
            templates, p["place"], lambda text: self.clause(text, p["terms"], None, index)
        )
        kept = F.filter(placed, lambda p: build(p, F.lit(1)).isNotNull())
        clauses = F.transform(kept, lambda p, i: build(p, i + 1))
        return F.array_join(clauses, series["delimiter"])

    def term_series(self, series: dict, current: Column | None) -> Column:
        """One clause per term of a topic."""
        templates = series["templates"]
        named = [t for t in TOKEN.findall(templates[0]) if t in self.topics or t == "term"]
        if len(named) != 1:
            raise UrlError("a term series needs exactly one term token")
        terms = self.terms(named[0], current)
        clauses = F.transform(
            terms,
            lambda _, i: self._by_place(
                templates, i, lambda text: self.clause(text, terms, i, i + 1)
            ),
        )
        return F.array_join(clauses, series["delimiter"])


def search_plan(searches: DataFrame, providers: dict[str, UrlTemplate], topics: list[str],
                data: str = "search_data") -> DataFrame:
    """Every search at every enabled provider, with its URL.

    The provider catalog is configuration held by the driver, so the fan-out is
    an explode within the row. Without providers there is no plan.
    """
    if not providers:
        nothing = F.lit(None).cast("string")
        return searches.select("*", nothing.alias("provider"), nothing.alias("url")).filter(F.lit(False))
    plans = F.array(
        *[
            F.struct(F.lit(name).alias("provider"), url.column(F.col(data), topics).alias("url"))
            for name, url in sorted(providers.items())
        ]
    )
    return searches.select("*", F.explode(plans).alias("_p")).select(
        *searches.columns, "_p.provider", "_p.url"
    ).filter("url is not null")

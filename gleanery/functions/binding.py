"""Evaluate an expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = chr(1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    An expression repeated inside a higher-order function runs again for every
    entry; a bound variable does not.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def with_groups(text: Column, pattern: str, groups: int,
                body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of the texts of a pattern's groups; null where the pattern misses.

    A group that took no part is ``''``. The pattern must cover the whole text; it
    runs once, however many groups there are.
    """
    replacement = "".join(f"{MARK}${i}" for i in range(1, groups + 1))
    parts = F.split(F.regexp_replace(text, pattern, replacement), MARK, groups + 1)
    return let(
        parts,
        lambda p: F.when(
            F.size(p) == groups + 1, body([F.get(p, F.lit(i + 1)) for i in range(groups)])
        ),
    )

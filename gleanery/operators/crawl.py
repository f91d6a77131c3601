"""Crawl order and pace: URLs per domain, popularity order, dwell times, schedule.

Random numbers come from a hash of (seed, key, draw), so they do not depend on
partitioning and a lost task redraws the same values.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.ordered import id_chunk, row_positions, running_sum
from gleanery.session import cut_lineage, self_contained

self_contained(__name__)

ATTEMPTS = 10
SELECTION_RATE = 0.393  # rate at which the first of a list is picked 32.5 % of the time


def draw_bits(seed: int, *key: Column) -> Column:
    """52 random-looking bits: the first digits of the MD5 of seed and key, which any engine can state."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *key: Column) -> Column:
    """Uniform draw in (0, 1) from a hash of the key."""
    return (draw_bits(seed, *key) + 0.5) / float(1 << 52)


def exponential(rate: float, seed: int, *key: Column) -> Column:
    return -F.ln(uniform(seed, *key)) / rate


def lognormal(mu: float, sigma: float, seed: int, *key: Column) -> Column:
    radius = F.sqrt(-2 * F.ln(uniform(seed, F.lit("radius"), *key)))
    angle = F.cos(2 * math.pi * uniform(seed, F.lit("angle"), *key))
    return F.exp(F.lit(float(mu)) + sigma * radius * angle)


def exponential_index(rate: float, length: Column, seed: int, *key: Column,
                      attempts: int = ATTEMPTS) -> Column:
    """Index below ``length``: the first draw in range, else 0."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    draws = [exponential(rate, seed, F.lit(i), *key) for i in range(attempts)]
    tries = F.coalesce(*[F.when(d < length, F.floor(d)) for d in draws], F.lit(0).cast("bigint"))
    bad = F.raise_error(F.lit("length must be at least 1")).cast("bigint")
    return F.when(length < 1, bad).otherwise(F.when(length > 1, tries).otherwise(F.lit(0)))


def bounded_lognormal(mu: float, sigma: float, minimum: float, maximum: float | None, seed: int,
                      *key: Column, attempts: int = ATTEMPTS) -> Column:
    """First draw within the bounds, else the distribution's mode."""
    high = math.inf if maximum is None else maximum
    draws = [lognormal(mu, sigma, seed, F.lit(i), *key) for i in range(attempts)]
    hits = [F.when(d.between(F.lit(float(minimum)), F.lit(float(high))), d) for d in draws]
    return F.coalesce(*hits, F.lit(math.exp(mu - sigma**2)))


@dataclass(frozen=True)
class Dwell:
    """Waiting time: a bounded lognormal, scaled and shifted. Times in seconds."""

    mu: float = 0
    sigma: float = 0.5
    base: float = 1
    multiplier: float = 1
    minimum: float = 1
    maximum: float | None = 3

    @classmethod
    def from_config(cls, config: dict | None) -> Dwell:
        """Defaults overridden by a site's settings; unknown settings are ignored."""
        known = asdict(cls())
        return cls(**{k: v for k, v in (config or {}).items() if k in known})

    def column(self, seed: int, *key: Column) -> Column:
        low = (self.minimum - self.base) / self.multiplier
        high = None if self.maximum is None else (self.maximum - self.base) / self.multiplier
        drawn = bounded_lognormal(self.mu, self.sigma, low, high, seed, *key)
        return self.base + drawn * self.multiplier


def urls_by_domain(urls: DataFrame, domain: str, order: str, name: str = "position",
                   size: str | None = None) -> DataFrame:
    """URLs numbered within their domain: the group as rows, however large it is."""
    return row_positions(urls, [domain], [F.col(order)], None, name, size)


def schedule(urls: DataFrame, domain: str, position: str, gap: Column, name: str = "start") -> DataFrame:
    """Start offset of each fetch: a domain's fetches wait for each other, the first does not."""
    gaps = urls.withColumn("_gap", F.when(F.col(position) == 1, F.lit(0.0)).otherwise(gap))
    return running_sum(
        gaps, [domain], [F.col(position)], id_chunk(F.col(position)), "_gap", name
    ).drop("_gap")


#: An entry of a list of those passed over: a place in the group, or below 0 one carried into the chunk.
WALKED = "_chunk long, _t long, _slot long, _ref long"


def _walk_chunk(times: np.ndarray, draws: np.ndarray, first: int) -> tuple[list[int], list[int]]:
    """What each pick of a chunk takes, and what it leaves passed over.

    ``first`` is the first place that no pick before the chunk has reached. The entries passed over
    before are not known here: the ``i``-th of them is written ``-1 - i``.
    """
    left = [-1 - i for i in range(first - int(times[0]))]
    taken = []
    for t, j in zip(times.tolist(), draws.tolist(), strict=True):
        if j < len(left):
            taken.append(left.pop(j))
        else:
            left.extend(range(first, j + t))
            taken.append(j + t)
            first = j + t + 1
    return taken, left


def _same(left: DataFrame, right: DataFrame, group: str, *pairs: tuple[str, str]) -> Column:
    """Join condition; null groups meet."""
    return reduce(and_, [left[a] == right[b] for a, b in pairs], left[group].eqNullSafe(right["_group"]))


def _followed(carried: DataFrame, group: str) -> DataFrame:
    """Replace entries that were carried into a chunk by their places, following them back by doubled links."""
    while not carried.filter(F.col("_from").isNotNull()).isEmpty():
        back = carried.select(
            F.col(group).alias("_group"), *[F.col(c).alias(f"_back{c}") for c in ("_chunk", "_slot", "_at", "_from", "_there")]
        )
        open_, done = carried.filter(F.col("_from").isNotNull()), carried.filter(F.col("_from").isNull())
        met = open_.join(back, _same(open_, back, group, ("_from", "_back_chunk"), ("_there", "_back_slot")))
        carried = cut_lineage(done.unionByName(met.select(
            group, "_chunk", "_slot", F.col("_back_at").alias("_at"), F.col("_back_from").alias("_from"), F.col("_back_there").alias("_there")
        )))
    return carried


def popularity_order(rows: DataFrame, group: str, position: str, size: str, seed: int,
                     rate: float = SELECTION_RATE, name: str = "pick",
                     chunk_rows: int | None = None) -> DataFrame:
    """Order in which a person would pick from each group's ranked list.

    Pick ``t`` takes the ``j``-th of the entries left, ``j`` an exponential index. All picks
    before ``t`` reach up to place ``max(j_s + s)``, and of the places up to there those not
    picked are passed over. So the number of entries passed over before a chunk of picks
    follows from a running maximum, and each chunk is picked apart on its own, with numbered
    stand-ins for the entries carried into it. A chunk's stand-ins are looked up in the list
    that the chunk before leaves, which is chained back by doubled links.

    The order is that of one pick after the other, at any rate above 0. A list carried between
    chunks is no longer than the largest index drawn, at most 37 / ``rate``; by default a chunk is longer than
    that. ``position`` is the 1-based place within the group, without gaps, and ``size`` the group's row count.
    Null groups are a group.
    """
    if not rate > 0:
        raise ValueError("the selection rate must be above 0")
    chunk_rows = chunk_rows or max(1 << 16, math.ceil(64 / rate))
    rows = cut_lineage(rows)
    t = F.col(position).cast("bigint") - 1
    index = exponential_index(rate, F.col(size) - F.col("_t"), seed, F.col(group), F.col("_t"))
    steps = rows.select(group, t.alias("_t"), F.col(size)).select(
        group, "_t", index.alias("_j"), id_chunk(F.col("_t"), chunk_rows).alias("_chunk")
    )
    reached = steps.groupBy(group, "_chunk").agg(F.max(F.col("_j") + F.col("_t")).alias("_top"))
    before = W.partitionBy(group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    borders = reached.select(
        F.col(group).alias("_group"), F.col("_chunk").alias("_of"), (F.coalesce(F.max("_top").over(before), F.lit(-1)) + 1).alias("_first")
    )
    steps = steps.join(borders, _same(steps, borders, group, ("_chunk", "_of"))).select(group, "_chunk", "_t", "_j", "_first")

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_t")
        taken, left = _walk_chunk(frame["_t"].to_numpy(), frame["_j"].to_numpy(), int(frame["_first"].iloc[0]))
        out = pd.DataFrame({
            "_chunk": np.full(len(taken) + len(left), int(key[1])),
            "_t": pd.array([*frame["_t"].tolist(), *[None] * len(left)], dtype="Int64"),
            "_slot": pd.array([*[None] * len(taken), *range(len(left))], dtype="Int64"),
            "_ref": np.array(taken + left, np.int64),
        })
        out.insert(0, group, pd.Series([key[0]] * len(out), dtype=object))
        return out

    kind = rows.schema[group].dataType.simpleString()
    walked = cut_lineage(steps.groupBy(group, "_chunk").applyInPandas(walk, f"`{group}` {kind}, {WALKED}"))
    known, slot = F.col("_ref") >= 0, -1 - F.col("_ref")
    linked = walked.select(
        group, "_chunk", "_t", "_slot", F.when(known, F.col("_ref")).alias("_at"),
        F.when(~known, F.col("_chunk") - 1).alias("_from"), F.when(~known, slot).alias("_there"),
    )
    carried = _followed(linked.filter(F.col("_slot").isNotNull()).drop("_t"), group)
    picks = linked.filter(F.col("_t").isNotNull())
    unknown = picks.filter(F.col("_from").isNotNull()).drop("_at")
    lists = carried.select(F.col(group).alias("_group"), F.col("_chunk").alias("_of"), F.col("_slot").alias("_place"), "_at")
    met = unknown.join(lists, _same(unknown, lists, group, ("_from", "_of"), ("_there", "_place")))
    placed = picks.filter(F.col("_from").isNull()).select(group, "_t", "_at").unionByName(met.select(group, "_t", "_at"))
    placed = placed.select(F.col(group).alias("_group"), (F.col("_at") + 1).alias("_position"), (F.col("_t") + 1).alias("_pick"))
    payload = [F.col(c) for c in rows.columns if c != group]
    return rows.join(placed, _same(rows, placed, group, (position, "_position"))).select(
        group, *payload, F.col("_pick").alias(name)
    )


def random_per_group(rows: DataFrame, keys: list[str], identity: str, seed: int) -> DataFrame:
    """One row per group, each row equally likely; an aggregation, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    draw = draw_bits(seed, F.col(identity))
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(draw, F.col(identity))).alias("_row")
    ).select(*keys, "_row.*")

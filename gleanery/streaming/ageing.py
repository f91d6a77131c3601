"""Statuses that age: a keyed state follows each extraction's status writes and the time between them.

A write is accepted or refused by the status before it and, where a finished extraction is
started again, by the time since (``is_legal`` says which steps there are; here they also wait).
A start that nothing follows in time is given up: as empty if pages were read for it, else as failed.
Refused writes change nothing and are returned beside the changes.

Rows may arrive out of order by up to the watermark's delay: a key's rows wait in its state until the
watermark has passed them, and are then taken in the order of time and id. So what is returned depends
neither on how rows fall into batches nor on restarts. A row later than the delay is dropped by Spark, and so is
one not after 1970-01-01, where its watermark begins.

Defined cases: rows without a status move the clock only; a repeated status is accepted and renews
its time; a deadline comes before a write of the same moment; null keys are keys as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.status import COMPLETED, EMPTY, FAILURE, INITIATED, PRELIMINARY, TRANSITIONS
from gleanery.session import self_contained

self_contained(__name__)

ACCEPTED, REFUSED, AGED = "accepted", "refused", "aged"
#: Groups that keys are dealt over by hash. One state holds a group's keys, so what a call costs is shared by many keys;
#: what a group takes grows with the keys a group has. A stream keeps the number it began with.
BUCKETS = 2048
HELD = "name array<string>, status array<int>, since array<long>, answered array<boolean>"
STATE = HELD + ", owner array<string>, ts array<long>, id array<long>, code array<int>, read array<boolean>"
#: Keys are written as JSON inside the state, whole to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Steps that wait: an extraction starts again.
RESTARTS = {(FAILURE, INITIATED), (EMPTY, INITIATED)}
REOPENS = {(COMPLETED, PRELIMINARY)}

Row = tuple[int, int, int, bool]


@dataclass(frozen=True)
class Held:
    """A key's status, since when (microseconds), and whether pages were read since it was started."""

    status: int | None = None
    since: int = 0
    answered: bool = False


@dataclass(frozen=True)
class Ageing:
    """Times in microseconds: until a start is given up, until it may be repeated, until finished work may re-open."""

    patience: int
    retry: int
    reopen: int

    def deadline(self, held: Held) -> int | None:
        return held.since + self.patience if held.status == INITIATED else None

    def given_up(self, held: Held, now: int) -> Held | None:
        """The status that a start has become by ``now``, if it was given up."""
        deadline = self.deadline(held)
        if deadline is None or deadline > now:
            return None
        return Held(EMPTY if held.answered else FAILURE, deadline)

    def follows(self, held: Held, ts: int, status: int) -> bool:
        if held.status is None:
            return status == INITIATED
        step, waited = (held.status, status), ts - held.since
        if step in RESTARTS:
            return waited >= self.retry
        if step in REOPENS:
            return waited >= self.reopen
        return held.status == status or status in TRANSITIONS[held.status]

    def walk(self, held: Held, rows: list[Row], now: int) -> tuple[Held, list[tuple]]:
        """Take ``rows``, in order, then let time pass until ``now``: the new status and what happened."""
        found = []

        def age(held: Held, until: int) -> Held:
            aged = self.given_up(held, until)
            if aged is None:
                return held
            found.append((None, aged.since, aged.status, held.status, AGED))
            return aged

        for ts, number, status, read in rows:
            held = age(held, ts)
            taken = self.follows(held, ts, status)
            found.append((number, ts, status, held.status, ACCEPTED if taken else REFUSED))
            if taken:
                again = held.status == status == INITIATED and held.answered
                held = Held(status, ts, read or again)
        return age(held, now), found


def aged_statuses(log: DataFrame, keys: list[str], rules: Ageing, delay: str, order: str = "event_id",
                  buckets: int = BUCKETS) -> DataFrame:
    """Follow a stream of status writes ``ts, <order>, status, answered``.

    Returns a row for each write and each start given up: the keys, ``<order>`` (null where time alone
    passed), ``ts``, ``status``, ``previous`` (the status held) and ``kind``. Rows come when the watermark,
    ``delay`` behind the latest ``ts``, has passed them; of a key are held one status and the rows within the delay.
    """
    fields = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    schema = f"_name string, `{order}` bigint, _at bigint, status int, previous int, kind string"

    def follow(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, Held] = {}
        waiting: dict[str, list[Row]] = {}
        if state.exists:
            names, status, since, answered, owners, *columns = state.get
            held = {n: Held(*h) for n, *h in zip(names, status, since, answered, strict=True)}
            for owner, row in zip(owners, zip(*columns, strict=True), strict=True):
                waiting.setdefault(owner, []).append(row)
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame[frame["_code"].notna()]
                for owner, t, n, c, r in zip(*(frame[k].tolist() for k in ("_name", "_at", "_id", "_code", "_read")), strict=True):
                    waiting.setdefault(owner, []).append((int(t), int(n), int(c), bool(r)))
        watermark = state.getCurrentWatermarkMs()
        now = watermark * 1000
        found, pending, after, rest = [], [], [], []
        for name in {**held, **waiting}:
            rows = sorted(waiting.get(name, ()))
            ready = [row for row in rows if row[0] <= now]
            now_held, steps = rules.walk(held.get(name, Held()), ready, now)
            found += [(name, *step) for step in steps]
            if now_held.status is not None:
                after.append((name, now_held.status, now_held.since, now_held.answered))
            rest += [(name, *row) for row in rows[len(ready):]]
            pending += [row[0] for row in rows[len(ready):len(ready) + 1]]
            pending += [d for d in [rules.deadline(now_held)] if d is not None]
        if not after and not rest:
            if state.exists:
                state.remove()
        else:
            columns = [list(c) for c in zip(*after, strict=True)] if after else [[] for _ in range(4)]
            columns += [list(c) for c in zip(*rest, strict=True)] if rest else [[] for _ in range(5)]
            state.update(tuple(columns))
            if pending:
                state.setTimeoutTimestamp(max(-(-min(pending) // 1000), watermark + 1))
        if found:
            whole = {order: "Int64", "status": "Int64", "previous": "Int64"}
            names = ["_name", order, "_at", "status", "previous", "kind"]
            yield pd.DataFrame({n: pd.Series(list(c), dtype=whole.get(n)) for n, c in zip(names, zip(*found, strict=True), strict=True)})

    code = F.col("status").cast("int")
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"),
        F.to_json(F.struct(*keys), {**TIMES, "ignoreNullFields": "false"}).alias("_name"),
        "ts", F.unix_micros("ts").alias("_at"), code.alias("_code"),
        # Rows that only move the clock may lack an id; a null among ids would make all of them floating.
        F.when(code.isNull(), 0).otherwise(F.col(order).cast("long")).alias("_id"),
        F.coalesce(F.col("answered"), F.lit(False)).alias("_read"),
    )
    followed = rows.groupBy("_bucket").applyInPandasWithState(follow, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    named = F.from_json("_name", ", ".join(f"`{k}` {fields[k]}" for k in keys), TIMES)
    return followed.withColumn("_key", named).select(
        *[F.col("_key")[k].alias(k) for k in keys], order, F.timestamp_micros("_at").alias("ts"), "status", "previous", "kind"
    )

"""Enumerations as integer codes with labels; label look-ups are literal maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Enumeration:
    """Ordered label -> code pairs. ``increasing`` says which way codes rank."""

    name: str
    members: tuple[tuple[str, int], ...]
    increasing: bool = True

    @classmethod
    def of(cls, name: str, increasing: bool = True, **members: int) -> Enumeration:
        return cls(name, tuple(members.items()), increasing)

    # -- single values ------------------------------------------------------

    def code_of(self, label: Column) -> Column:
        """Code of a label, ignoring case; null when unknown."""
        pairs = [F.lit(x) for member, code in self.members for x in (member.upper(), code)]
        return F.try_element_at(F.create_map(*pairs), F.upper(label))

    def label_of(self, code: Column) -> Column:
        """Label of a code; null when unknown."""
        pairs = [F.lit(x) for member, code_ in self.members for x in (code_, member)]
        return F.try_element_at(F.create_map(*pairs), code.cast("int"))

    def cast(self, label: Column, nullable: bool = False) -> Column:
        """Code of a label; unknown labels fail, nulls too unless ``nullable``."""
        return self._checked(label, self.code_of(label), nullable)

    def member(self, code: Column, nullable: bool = False) -> Column:
        """The code itself, checked to belong to the enumeration."""
        known = F.when(self.label_of(code).isNotNull(), code.cast("int"))
        return self._checked(code.cast("string"), known, nullable)

    def _checked(self, given: Column, code: Column, nullable: bool) -> Column:
        reason = F.concat(
            F.coalesce(given, F.lit("null")), F.lit(f" is not a valid {self.name}")
        )
        error = F.raise_error(reason).cast("int")
        if nullable:
            return F.when(given.isNull(), F.lit(None).cast("int")).otherwise(
                F.coalesce(code, error)
            )
        return F.coalesce(code, error)

    def qualified(self, code: Column) -> Column:
        """``Name.LABEL`` text of a code."""
        return F.concat(F.lit(f"{self.name}."), self.label_of(code))

    def from_qualified(self, text: Column) -> Column:
        """Code of a qualified text, whatever its prefix."""
        return self.code_of(F.substring_index(text, ".", -1))

    def strength(self, code: Column) -> Column:
        """Sort value: larger means higher in the enumeration's own order."""
        return code if self.increasing else -code

    def compare(self, left: Column, right: Column) -> Column:
        """-1, 0 or 1 in the enumeration's own order."""
        return F.signum((self.strength(left) - self.strength(right)).cast("double")).cast("int")

    # -- aggregates ----------------------------------------------------------

    def maximum(self, code: Column, nullable: bool = True) -> Column:
        picked = F.max(code) if self.increasing else F.min(code)
        return picked if nullable else self._strict(code, picked)

    def minimum(self, code: Column, nullable: bool = True) -> Column:
        picked = F.min(code) if self.increasing else F.max(code)
        return picked if nullable else self._strict(code, picked)

    def _strict(self, code: Column, picked: Column) -> Column:
        """Fail on a null among the values, or on no values at all."""
        bad = (F.count(F.lit(1)) != F.count(code)) | (F.count(code) == 0)
        return F.when(bad, F.raise_error(F.lit(f"null or no {self.name}")).cast("int")).otherwise(
            picked
        )

    def consolidate(
        self, rows: DataFrame, keys: list[str], code: str, merge: Callable[[Column, Column], Column]
    ) -> DataFrame:
        """Reduce each group's members with ``merge`` into one member.

        ``merge`` must be associative and commutative (max, bit-or, a sum of codes,
        ...). Codes outside the enumeration fail. Members are counted first, so the list
        merged per group is never longer than the enumeration; a member that occurs n times is
        merged with itself by doubling, in log n steps. A result outside the enumeration fails.
        """
        known = rows.filter(F.col(code).isNotNull()).withColumn(code, self.member(F.col(code)))
        counted = known.groupBy(*keys, code).agg(
            F.count(F.lit(1)).alias("_n")
        )
        entry = F.struct(F.col(code).cast("int").alias("code"), F.col("_n").alias("n"))
        members = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
        powers = F.transform("_m", lambda m: _repeated(m["code"], m["n"], merge))
        merged = F.reduce(
            F.slice(powers, F.lit(2), F.size(powers)), F.get(powers, F.lit(0)), merge
        )
        reduced = members.select(*keys, merged.alias(code))
        return reduced.select(*keys, self.member(F.col(code)).alias(code))

    # -- containers ----------------------------------------------------------

    def pairs(
        self,
        swap: bool = False,
        labels: bool = False,
        inverse: bool = False,
        transform: Callable[[str], str] | None = None,
    ) -> list[tuple]:
        """(label, code) pairs, optionally swapped, label-only, transformed, inverted."""
        if swap:
            out = [(code, label) for label, code in self.members]
        else:
            out = [(label, label if labels else code) for label, code in self.members]
        if transform:
            out = [(transform(a), b) for a, b in out]
        return [(b, a) for a, b in out] if inverse else out

    def table(self, spark: SparkSession) -> DataFrame:
        """The members as a table; as small as the definition above."""
        return spark.createDataFrame(list(self.members), "label string, code int")

    def as_map(self, **options) -> Column:
        """The pairs as a literal map column."""
        return F.create_map(*[F.lit(x) for pair in self.pairs(**options) for x in pair])


def _repeated(value: Column, times: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``value`` merged with itself until it stands for ``times`` occurrences.

    Goes through the bits of ``times`` from the top: double, then add one if set.
    """
    top = F.floor(F.log2(times.cast("double"))).cast("int")
    places = F.when(top > 0, F.sequence(top - 1, F.lit(0), F.lit(-1))).otherwise(
        F.array().cast("array<int>")
    )
    bit = lambda place: F.call_function("getbit", times, place) == 1

    def step(acc: Column, place: Column) -> Column:
        doubled = merge(acc, acc)
        return F.when(bit(place), merge(doubled, value)).otherwise(doubled)

    return F.aggregate(places, value, step)

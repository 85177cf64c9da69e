"""Filters that account for every row: criteria with unstated values, narrowing, sampling of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    """reason: what a row that fails is reported under. An unstated (null) field keeps the row unless strict."""

    reason: str
    field: str
    test: Column

    def passes(self, strict: bool) -> Column:
        # the OR form, not coalesce(test, true), is pushed down to Parquet
        return F.coalesce(self.test, F.lit(False)) if strict else self.test | F.col(self.field).isNull()


def drop_reason(criteria: list[Criterion], strict: bool = False) -> Column:
    """The first failing criterion's reason; null for a row that stays."""
    chosen = None
    for c in criteria:
        fails = ~c.passes(strict)
        chosen = F.when(fails, c.reason) if chosen is None else chosen.when(fails, c.reason)
    return chosen


def apply_criteria(df: DataFrame, criteria: list[Criterion], strict: bool = False) -> DataFrame:
    """Only the rows that stay, as one conjunction that scans can use."""
    for c in criteria:
        df = df.where(c.passes(strict))
    return df


def unchecked(criteria: list[Criterion]) -> Column:
    """The criteria a row couldn't be held against."""
    return F.array_compact(F.array(*(F.when(F.col(c.field).isNull(), c.reason) for c in criteria)))


@dataclass(frozen=True)
class Choice:
    """Which values of a column are wanted. None wanted: any; hidden ones never; unstated: whether null is."""

    wanted: list[str] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)
    unstated: bool = True

    def matches(self, c: Column) -> Column:
        return (
            F.when(F.coalesce(c.isin(self.hidden), F.lit(False)) if self.hidden else F.lit(False), False)
            .when(c.isNull(), self.unstated)
            .otherwise(c.isin(self.wanted) if self.wanted else F.lit(True))
        )


def within_band(cents: Column, low: Column, high: Column, track_low: Column, track_high: Column) -> Column:
    """In whole units; an end of the band that rests on the end of the track is no bound."""
    units = cents / 100.0
    return ((low <= track_low) | (units >= F.floor(low))) & ((high >= track_high) | (units <= F.ceil(high)))


def narrow(df: DataFrame, price: str, band: tuple[float, float], conditions: Choice, sale_types: Choice, new: DataFrame | Column | None = None, scams: DataFrame | Column | None = None) -> DataFrame:
    """Unsold offers within a price band (in units) and of the wanted kinds. Its two ends are held inside what there is. Which
    offers are new and which are scams is told by tables of ids or, where the rows tell it themselves, by conditions."""
    active = df.where(~F.col("sold"))
    ends = active.agg((F.min(price) / 100.0).alias("_lo"), F.greatest(F.max(price) / 100.0, F.min(price) / 100.0 + 1).alias("_hi"))
    held = lambda x: F.least(F.greatest(F.lit(float(x)), F.col("_lo")), F.col("_hi"))
    rows = active.crossJoin(F.broadcast(ends))  # one row
    rows = rows.where(within_band(F.col(price), held(band[0]), held(band[1]), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    rows = rows.where(conditions.matches(F.col("condition"))).where(sale_types.matches(F.col("sale_type")))
    if new is not None:
        rows = rows.where(new) if isinstance(new, Column) else rows.join(new, "id", "left_semi")
    if scams is None:
        return rows
    return rows.where(~F.coalesce(scams, F.lit(False))) if isinstance(scams, Column) else rows.join(scams, "id", "left_anti")


def round_robin(df: DataFrame, groups: list[str], order: str, limit: int) -> DataFrame:
    """Row 1 of each group, then row 2 of each, ... until limit; groups in the order of their first rows."""
    w = Window.partitionBy(*groups)
    few = df.withColumn("_rank", F.row_number().over(w.orderBy(order))).where(F.col("_rank") <= limit)
    return few.withColumn("_first", F.min(order).over(w)).orderBy("_rank", "_first").limit(limit).drop("_rank", "_first")

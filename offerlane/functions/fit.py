"""Weighed fit of offers to wishes, and labels of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an unanswered wish counts, and prices of a kWh in cents.
UNKNOWN = 0.45
SOLAR_CENT, GRID_CENT, PUBLIC_CENT = 8.0, 37.3, 56.0


def stated_wish(value: Column, wanted: str, unstated: float, other: float) -> Column:
    return F.when(value.isNull(), unstated).when(value == wanted, 1.0).otherwise(other)


def size_wish(size: Column, wanted: tuple[int, int], possible: tuple[int, int]) -> Column:
    return F.when(size.isNull(), 0.35).when(size.between(*wanted), 1.0).when(size.between(*possible), 0.6).otherwise(0.1)


def weighed(wishes: list[tuple[str, Column, float]]) -> Column:
    """array<struct<wish, got, of>>: each wish's score, and its points out of 100 by its weight's share of all."""
    total = sum(w for _, _, w in wishes)
    return F.array(*(F.struct(F.lit(n).alias("wish"), F.coalesce(got.cast("double"), F.lit(UNKNOWN)).alias("got"), F.lit(w / total * 100).alias("of")) for n, got, w in wishes))


def score(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["got"] * p["of"]) / 100


def charging_cent(home_percent: Column, solar_percent: Column) -> Column:
    part = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c)) / 100.0
    home, solar = part(home_percent), part(solar_percent)
    return home * (solar * SOLAR_CENT + (1 - solar) * GRID_CENT) + (1 - home) * PUBLIC_CENT


def hours_label(hours: Column) -> Column:
    """~45 min, ~7 h."""
    quarters = (F.round(hours * 4) * 15).cast("long")
    return F.when(hours < 1, F.concat(F.lit("~"), quarters, F.lit(" min"))).otherwise(F.concat(F.lit("~"), F.round(hours).cast("long"), F.lit(" h")))

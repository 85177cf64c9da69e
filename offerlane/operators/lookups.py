"""Lookups by keys of falling exactness, and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(rows: DataFrame, known: DataFrame, keys: list[str], names: list[str], value: str, as_: str) -> DataFrame:
    """rows with the least value of known under the first of the keys that known has, and that key's name; the last name
    is for the least of all. known is reduced to a row a key before each join."""
    for k in keys:
        rows = rows.join(known.groupBy(k).agg(F.min(value).alias(f"_{k}")), k, "left")
    rows = rows.crossJoin(F.broadcast(known.agg(F.min(value).alias("_any"))))  # one row
    found = [f"_{k}" for k in keys] + ["_any"]
    told: Column = F.lit(names[-1])
    for c, n in reversed(list(zip(found[:-1], names))):
        told = F.when(F.col(c).isNotNull(), n).otherwise(told)
    return rows.withColumn(as_, F.coalesce(*found)).withColumn("found_by", told).drop(*found)


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], at: str, state_at: str) -> DataFrame:
    """rows with the last state of their key up to their time, or nulls. Both are laid in one order and the last state is
    carried along, so no row meets more than one state."""
    values = [c for c in states.columns if c not in (*keys, state_at)]
    left = rows.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(states.select(F.struct(state_at, *values)).schema[0].dataType).alias("_state"))
    right = states.select(*keys, F.col(state_at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"), F.struct(state_at, *values).alias("_state"))
    carried = F.last("_state", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    both = left.unionByName(right).withColumn("_state", carried).where("_kind = 1")
    return both.select("_row.*", *(F.col(f"_state.{c}").alias(c) for c in (state_at, *values)))

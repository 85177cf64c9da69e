"""Row-by-row comparisons within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key. The bound lets Spark keep only n rows a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before: FIRST_SEEN or PRICE_CHANGED, with the value before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    rows = df.withColumn("before", before).withColumn("event", F.when(first, "FIRST_SEEN").when(~F.col(value).eqNullSafe(before), "PRICE_CHANGED"))
    return rows.where("event is not null")


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of rows with equal values: (keys, value, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    runs = df.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(w))
    return runs.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def running(df: DataFrame, keys: list[str], order: list[str], name: str, what: Column) -> DataFrame:
    """what (min or max of a column) over the key's rows so far."""
    return df.withColumn(name, what.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_count(df: DataFrame, keys: list[str], at: str, seconds: int, name: str = "n") -> DataFrame:
    """How many of the key's rows lie within the seconds up to each row. Rows are dealt by key and time bucket, each into
    its own and the next bucket, so a key with many rows is many groups."""
    micros, span = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    bucket = F.floor(micros / span)
    dealt = df.select("*", micros.alias("_t"), F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))).alias("_in"))
    w = Window.partitionBy(*keys, "_in.b").orderBy("_t").rangeBetween(-span, 0)
    return dealt.withColumn(name, F.count(F.lit(1)).over(w)).where("_in.own").drop("_t", "_in")


def sessions(df: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """(keys, began, ended, n): runs of rows with no gap of gap_seconds or more."""
    t = F.col(at).cast("timestamp")
    w = F.session_window(t, f"{gap_seconds} seconds")
    return df.groupBy(*keys, w).agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n")).drop("session_window")


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 1024) -> DataFrame:
    """Rows with their place, from 0, in their key's order of a whole number: rows are numbered within ranges of `width`
    numbers, and only the ranges' counts are summed up by key. Rows with a null key are a key of their own; equal numbers
    are placed in any order."""
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_key", "_of", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    joined = rows.withColumn("_within", within).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_key", "_of", "_start", "_within")

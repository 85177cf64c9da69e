"""Statistics over prices, facets and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spreads(df: DataFrame, cents: str, keys: list[str], segments: dict[str, Column | None]) -> DataFrame:
    """Count, median and quartiles of each segment (prefix: condition, None for all rows), in units: linear between values,
    rounded to a cent. Equal values are counted before they are shuffled; only distinct ones are put in order, once for
    all segments. From cents the interpolation is exact, so that no rounding hangs on a last bit."""
    of = lambda c: F.count(F.lit(1)) if c is None else F.count_if(c)
    counts = df.where(F.col(cents).isNotNull()).groupBy(*keys, cents).agg(*(of(c).alias(f"_n_{p}") for p, c in segments.items()))
    all_ = Window.partitionBy(*keys)
    upto = all_.orderBy(cents)
    laid = counts.select(*keys, cents, *(F.sum(f"_n_{p}").over(upto).alias(f"_upto_{p}") for p in segments), *(F.sum(f"_n_{p}").over(all_).alias(f"_of_{p}") for p in segments))
    picked, told = [], []
    for p in segments:
        n = F.col(f"_of_{p}")
        picked.append(F.max(n).alias(f"{p}count"))
        for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            low = F.floor((n - 1) * q)
            for side, place in (("lo", low), ("hi", F.least(low + 1, n - 1))):
                picked.append(F.min(F.when((n > 0) & (F.col(f"_upto_{p}") > place), F.col(cents))).alias(f"_{p}{name}_{side}"))
            lo, hi, at = F.col(f"_{p}{name}_lo"), F.col(f"_{p}{name}_hi"), (F.col(f"{p}count") - 1) * q
            told.append((F.round(lo + (hi - lo) * (at - F.floor(at))) / 100).alias(f"{p}{name}"))
    found = laid.groupBy(*keys).agg(*picked)
    return found.select(*keys, *(f"{p}count" for p in segments), *told)


def upper_median(df: DataFrame, value: str, keys: list[str], name: str = "middle") -> DataFrame:
    """The value at place n div 2 (from 0) of each group's sorted values. Equal values are counted before they are
    shuffled, and only distinct ones are put in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    ordered = counts.select(*keys, value, F.sum("count").over(w.orderBy(value)).alias("_upto"), F.sum("count").over(w).alias("_n"))
    return ordered.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > F.expr("_n div 2"), F.col(value))).alias(name), F.max("_n").alias("n"))


def histogram(df: DataFrame, value: str, keys: list[str], buckets: int = 12) -> DataFrame:
    """Equal widths between each group's least and greatest value; the last bucket is closed."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) / F.lit(float(buckets))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")
    return df.join(ends, keys).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Counts by each column's values, null its own group, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(*keys, pairs.alias("_p")).groupBy(*keys, "_p.facet", "_p.value").agg(F.count(F.lit(1)).alias("n"))


def whatif(df: DataFrame, criteria: dict[str, Column], keys: list[str] = []) -> DataFrame:
    """For each criterion, how many rows only it holds back; and how many pass all. One pass over a bit mask of failures."""
    mask = None
    for i, c in enumerate(criteria.values()):
        bit = F.when(c, 0).otherwise(1 << i)
        mask = bit if mask is None else mask + bit
    rows = df.select(*keys, mask.alias("_mask"))
    return rows.groupBy(*keys).agg(F.count_if(F.col("_mask") == 0).alias("shown"), *(F.count_if(F.col("_mask") == 1 << i).alias(f"without_{n}") for i, n in enumerate(criteria)))


def share_carrying(df: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """(keys, token, n_rows, share): in how many of a group's rows a token stands."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    having = df.select(*keys, F.explode(F.array_distinct(words)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n_rows"))
    return having.join(sizes, keys).select(*keys, "token", "n_rows", (F.col("n_rows") / F.col("rows")).alias("share"))


def confusion(df: DataFrame, score: str, label: str, keys: list[str] = [], bar: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall and the distance of the classes' mean scores."""
    said, true = F.col(score) >= bar, F.col(label) == 1
    n = lambda c, name: F.count_if(c).alias(name)
    a = df.groupBy(*keys).agg(n(said & true, "tp"), n(said & ~true, "fp"), n(~said & true, "fn"), n(~said & ~true, "tn"), F.avg(F.when(true, F.col(score))).alias("_m1"), F.avg(F.when(~true, F.col(score))).alias("_m0"))
    part = lambda x, y: F.when(y > 0, F.round(x / y * 1e6) / 1e6)
    c = F.col
    return a.select(*keys, "tp", "fp", "fn", "tn", part(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), part(c("tp"), c("tp") + c("fp")).alias("precision"), part(c("tp"), c("tp") + c("fn")).alias("recall"), (F.round((c("_m1") - c("_m0")) * 1e6) / 1e6).alias("separation"))


def whole_points(df: DataFrame, key: list[str], value: str, name: str, total: int = 100) -> DataFrame:
    """Shares of total as whole numbers, by largest remainder: the sum of a key's points stays its rounded sum."""
    w = Window.partitionBy(*key)
    floor = F.floor(value)
    rows = df.withColumn("_left", (F.round(F.sum(value).over(w)) - F.sum(floor).over(w)).cast("int")).withColumn("_rank", F.row_number().over(w.orderBy(F.round(F.col(value) - floor, 9).desc(), name)))
    return rows.withColumn("points", (floor + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_left", "_rank")

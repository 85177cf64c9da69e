"""Scores from vectors and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and references of a block: what a task multiplies at a time.
QUERIES, REFERENCES = 1024, 4096
#: Similarities that a worker holds at a time, in the doubles they take.
SIMS = 1 << 20


def _blocks(df: DataFrame, columns: list[str], vector: str, size: int, names: list[str]) -> DataFrame:
    """df in rows of about size vectors each: an array for each column, in one order, and one of vectors of doubles."""
    blocks = max(1, -(-df.count() // size))
    rows = df.select(*columns, F.transform(vector, lambda x: x.cast("double")).alias("_v"), F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).alias("_block"))
    held = rows.groupBy("_block").agg(F.collect_list(F.struct(*columns, "_v")).alias("_held"))
    return held.select(*(F.col(f"_held.{c}").alias(n) for c, n in zip([*columns, "_v"], names)))


def _side(batch: pa.RecordBatch, at: int, row: int) -> np.ndarray:
    """The list of numbers, or the matrix, of a column of lists or lists of lists: a view of Arrow's values, no objects."""
    values = batch.column(at)[row].values
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def nearest(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int, by: str | None = None, digits: int | None = 6) -> DataFrame:
    """(key, other, sim), and by: the k likest references of each query by cosine, for each value of a column if `by` is
    given; ties by the smaller id. No vector is its own reference.

    Queries are a stated part of the table; they meet all references in blocks, a matrix product for some queries at a time
    (SIMS), and of each pair of blocks only k rows a query (and value) are left before anything is shuffled.
    """
    asked, told = _blocks(queries, [key], vector, QUERIES, ["_q", "_qv"]), _blocks(references, [key, *([by] if by else [])], vector, REFERENCES, ["_r", *(["_by"] if by else []), "_rv"])
    # a row for each pair of blocks; Spark ends an Arrow batch at 64 MB
    met = asked.crossJoin(told).select("_q", "_qv", "_r", F.col("_by" if by else "_r").alias("_by"), "_rv")

    def multiply(batches):
        for b in batches:
            for row in range(b.num_rows):
                ids, a, others, groups, r = (_side(b, at, row) for at in range(5))
                groups = groups if by else np.zeros(len(others), np.int64)
                size, step = (r * r).sum(1), max(1, SIMS // len(others))
                for at in range(0, len(ids), step):
                    yield _nearest_of(ids[at : at + step], a[at : at + step], others, groups, r, size, k, digits)

    found = met.mapInArrow(multiply, "id long, other long, by long, sim double")
    best = found.withColumn("_rank", F.row_number().over(Window.partitionBy("id", "by").orderBy(F.desc("sim"), "other"))).where(F.col("_rank") <= k)
    return best.select(F.col("id").alias(key), "other", *(["by"] if by else []), "sim")


def _nearest_of(ids, a, others, groups, r, size, k: int, digits: int | None) -> pa.RecordBatch:
    sims = np.einsum("ij,kj->ik", a, r) / np.sqrt(np.outer((a * a).sum(1), size))
    sims = sims if digits is None else np.round(sims * 10**digits) / 10**digits
    parts = []
    for i, mine in enumerate(sims):
        order = np.lexsort((others, -mine, groups))
        order = order[others[order] != ids[i]]
        rank = np.arange(len(order)) - np.searchsorted(groups[order], groups[order])
        top = order[rank < k]
        parts.append((np.full(len(top), ids[i], np.int64), others[top].astype(np.int64), groups[top].astype(np.int64), mine[top]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["id", "other", "by", "sim"])


def vote(near: DataFrame, key: str) -> DataFrame:
    """near(key, sim, worth) -> (key, score): the references' worth, weighted by (sim + 1) / 2, at least 0.01."""
    weight = F.greatest(F.lit(0.01), (F.col("sim") + 1) / 2)
    return near.groupBy(key).agg((F.sum(weight * F.col("worth")) / F.sum(weight)).alias("score"))


def cold_start(profile: Column, love: Column, dislike: Column) -> Column:
    """All mapped to 0..1; a signal that isn't there (null) counts nothing, a missing profile 0.5."""
    p = F.coalesce(profile, F.lit(0.5))
    s = p * 0.7 + F.coalesce(love, F.lit(0.0)) * 0.3 - F.greatest(F.lit(0.0), F.coalesce(dislike, p) - p) * 0.5
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def centroid_scores(df: DataFrame, key: str, vector: str, loved: Column, disliked: Column) -> DataFrame:
    """(key, score): distance to the disliked centre over both distances, each axis weighed by Fisher's criterion. The
    centres and weights are one row for each axis."""
    rows = df.select(key, loved.alias("_l"), disliked.alias("_d"), F.posexplode(vector).alias("_axis", "_x")).withColumn("_x", F.col("_x").cast("double"))
    of = lambda f, c: f(F.when(F.col(c), F.col("_x")))
    axes = rows.groupBy("_axis").agg(of(F.avg, "_l").alias("ml"), of(F.avg, "_d").alias("md"), of(F.var_pop, "_l").alias("vl"), of(F.var_pop, "_d").alias("vd"))
    axes = axes.withColumn("f", F.pow(F.col("ml") - F.col("md"), 2) / (F.col("vl") + F.col("vd") + 1e-8))
    axes = axes.crossJoin(F.broadcast(axes.agg(F.max("f").alias("most")))).select("_axis", "ml", "md", (F.col("f") / F.col("most")).alias("w"))
    far = lambda c: F.sqrt(F.sum(F.pow(F.col("w") * (F.col("_x") - F.col(c)), 2)))
    both = rows.join(F.broadcast(axes), "_axis").groupBy(key).agg(far("ml").alias("dl"), far("md").alias("dd"))  # one row for each axis
    return both.select(key, (F.col("dd") / (F.col("dl") + F.col("dd"))).alias("score"))


def gates(df: DataFrame, keys: list[str], score: str, right: Column, bars: list[float], share: float, least: int) -> DataFrame:
    """For each key the lowest bar at which at least `least` rows score, and at least `share` of those are right."""
    reached = F.filter(F.array(*map(F.lit, bars)), lambda b: F.col(score) >= b)
    rows = df.select(*keys, F.size(reached).alias("_n"), right.alias("_right")).where("_n > 0")
    counts = rows.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("told"), F.count_if("_right").alias("right"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"))
    # a bar that no row ends at has the counts of the next one above
    spread = counts.withColumn("told", F.sum("told").over(w)).withColumn("right", F.sum("right").over(w)).withColumn("_below", F.coalesce(F.lead("_n").over(w), F.lit(0)))
    ok = spread.where((F.col("told") >= least) & (F.col("right") / F.col("told") >= share))
    return ok.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, bars)), (F.min("_below") + 1).cast("int")).alias("bar"))

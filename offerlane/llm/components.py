"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, look_up


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the smallest node reachable. Nodes without an edge to another
    node are left out. Null ends and loops are ignored; repeated edges count once. Empty edges give an empty table.

    Every round is two grouped minima and two joins, so no node's neighbours are ever gathered in one row, and the edges
    of a hub stay where they lie (look_up). Each half of a round ends in a checkpoint.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    e = checkpointed(e.distinct())
    mark = _mark(e)
    if not mark[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = look_up(both.where("v > u"), least, "u", 2 * mark[0])
        # read four times below: without the checkpoint the driver would plan and broadcast all of the above each time
        large = checkpointed(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = look_up(large, lower, "u", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(lower.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

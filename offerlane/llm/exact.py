"""Exact deduplication of a batch against an immutable snapshot.

A snapshot is a table with a row for each distinct digest, and static binary-fuse filters over its digests, dealt into
shards of bounded size. An incoming batch is first grouped by digest on its own; each distinct digest is screened by the
filter of its shard; only positives join the snapshot's exact buckets. Filters never refuse what they hold, so the
result doesn't depend on them.

Exact buckets are keyed by SHA-256, and all texts of a bucket with more than one row are then compared byte by byte: by
the bucket's least and greatest text, of which every task sends one pair, so a hot group is never gathered. Texts that
are alone are neither compared nor shuffled. Should two texts of a bucket ever differ, the bucket is split by its texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, look_up, one_row, packed, row_hash, ship
from offerlane.llm.fuse import FuseFilter

#: Digests in a shard: what one task builds a filter of, or screens, at a time.
SHARD = 65_536
#: Digests of shared texts that are broadcast to find their rows (32 bytes each); of more, only the hot ones are, and the
#: rows of the others are shuffled.
BROADCAST_DIGESTS = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    groups: DataFrame  # sha, best, n: a row for each digest
    filters: DataFrame  # shard, filter
    shards: int


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, points, norm, sha): norm is the text without ASCII white space; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("points"), F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "").alias("norm"))
    return rows.select("*", F.unhex(F.sha2("norm", 256)).alias("sha"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, rank) of every row. rank orders equal texts: most code points first, then the smallest id, null ids
    last."""
    return _normalised(docs, id_col, text_col).select("doc_id", "sha", _rank().alias("rank"))


def _rank() -> Column:
    return F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def _grouped(rows: DataFrame) -> DataFrame:
    """A row for each digest; partial minima and counts come before the shuffle, so a hot digest is a row a task."""
    return rows.groupBy("sha").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))


def differing(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_DIGESTS) -> DataFrame:
    """(sha) of the buckets in groups(sha, n) whose texts, all compared byte by byte, aren't all the same."""
    shared = checkpointed(groups.where("n > 1").select("sha", "n"))
    texts = _normalised(docs, id_col, text_col).select("sha", "norm")
    total = shared.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    texts = texts.join(F.broadcast(shared.select("sha")), "sha", "left_semi") if total["digests"] <= most else look_up(texts, shared, "sha", total["rows"])
    ends = texts.groupBy("sha").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    return checkpointed(ends.where("least <> greatest").select("sha"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int")


def _keys(shas: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(s[:8] for s in shas), "<u8")


def build_snapshot(rows: DataFrame) -> Snapshot:
    """rows: of digests()."""
    ship(rows.sparkSession)
    groups = checkpointed(_grouped(rows))
    shards = max(1, -(-groups.count() // SHARD))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"][:1], "filter": [FuseFilter.build(_keys(pdf["sha"])).pack()]})

    filters = groups.select("sha", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")
    return Snapshot(groups, filters, shards)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """batch(sha, ...) -> (sha, maybe boolean): whether the snapshot's filter lets a digest pass."""

    def run(key, mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        passed = FuseFilter.unpack(filters["filter"][0]).screen(_keys(mine["sha"])) if len(filters) and len(mine) else np.zeros(len(mine), bool)
        return pd.DataFrame({"sha": mine["sha"], "maybe": passed})

    dealt = batch.select("sha", _shard(snapshot.shards).alias("shard")).groupBy("shard")
    return dealt.cogroup(snapshot.filters.groupBy("shard")).applyInPandas(run, "sha binary, maybe boolean")


def merge(batch_rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(sha, best, n) of every digest of the snapshot and the batch together."""
    fresh = checkpointed(_grouped(batch_rows))
    screened = fresh.join(screen(fresh, snapshot), "sha")
    screened = checkpointed(screened)
    maybe, new = screened.where("maybe"), screened.where("not maybe").select("sha", "best", "n")
    old = snapshot.groups.select("sha", F.col("best").alias("old_best"), F.col("n").alias("old_n"))
    both = old.join(maybe.select("sha", "best", "n"), "sha", "full")
    merged = both.select("sha", F.least("old_best", "best").alias("best"), (F.coalesce("old_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
    return merged.unionByName(new)


def _decided(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """digests() of docs, (sha, best, n) of each digest, and the digests whose texts differ, if there are any."""
    rows = checkpointed(digests(docs, id_col, text_col))
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    groups = checkpointed(merge(rows.where(~old), build_snapshot(rows.where(old))))
    differ = differing(docs, groups, id_col, text_col)
    return rows, groups, None if differ.isEmpty() else differ


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Rows whose hashed id is even are the snapshot, the others the incoming batch. Of equal texts the row with most code
    points, then the smallest id stays. Rows that repeat both id and length of a kept row are marked kept too; rows with
    a null id stay only in a group that has no id. Empty tables give empty results; other columns aren't read.
    """
    rows, groups, differ = _decided(docs, id_col, text_col)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = look_up(rows.select("doc_id", "sha", "rank"), groups.select("sha", "best", "n"), "sha", total)
    if differ is not None:
        split = _normalised(docs, id_col, text_col).join(differ, "sha", "left_semi").select("doc_id", "sha", _rank().alias("rank"), "norm")
        by_text = split.groupBy("sha", "norm").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
        found = found.join(differ, "sha", "left_anti").unionByName(split.join(by_text, ["sha", "norm"]).drop("norm"))
    return found.select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rank") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, and of each group of equal texts exactly one row: most code points, then the smallest
    id, null ids last. Rows without id, and rows that repeat an id, are kept and dropped like others."""
    _, groups, differ = _decided(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    sha, points = F.unhex(F.sha2(norm, 256)), (-F.char_length(text).cast("long")).alias("points")
    mark = F.struct(sha.alias("sha"), points, F.col(id_col).cast("long").alias("id"))
    if differ is None:
        return one_row(docs, mark, groups.select(F.struct("sha", "best.points", "best.id").alias("mark"), "n"))
    rank = F.struct(points, F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), row_hash(packed(docs)).alias("hash"))
    told = docs.select(packed(docs).alias("row"), sha.alias("sha"), norm.alias("norm"), rank.alias("rank"))
    split = told.join(differ, "sha", "left_semi").groupBy("sha", "norm").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    kept = groups.join(differ, "sha", "left_anti").select(F.struct("sha", "best.points", "best.id").alias("mark"), "n")
    return one_row(docs, mark, kept).unionByName(split)

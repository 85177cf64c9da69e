"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, Hamming verification, components.

A fingerprint of 64 bits is cut into `blocks` runs of bits. Two fingerprints that differ in at most `radius` bits agree
on at least blocks - radius whole runs, so they share the key of at least one choice of that many runs. Every distinct
fingerprint is dealt once under each choice; equal keys meet, and only pairs within the radius link.

Equal fingerprints are collapsed before anything is joined, so a group of exact copies is one row. A key that more than
`HOT` distinct fingerprints share isn't compared pairwise: its fingerprints are linked through the midpoints of
their pairs instead (two fingerprints differ in at most 2t bits exactly if some point lies within t bits of both, and all
fingerprints within t bits of one point may be linked to each other), which is exact and grows in proportion.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, look_up, ship, texts_of
from offerlane.llm.components import connected_components

#: Distinct fingerprints under one key that one task compares (64 KB of them).
HOT = 8192
#: Keys beyond HOT whose set is broadcast (8 bytes each); more are joined.
BROADCAST_KEYS = 1_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """Of the lower-cased (A-Z) words between ASCII white space: a bit is set if more than half the shingles' XXH64 have it."""
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(words, len(ws)) - 1 :].tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(2048, np.int64), len(ends)
    place = np.tile(np.arange(8) * 256, min(n, _STEP))
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], dtype="<u8")
        counts += np.bincount(h.view(np.uint8) + place[: 8 * len(h)], minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long), one row for each row of docs. A null text counts as empty: fingerprint zero."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in texts_of(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The masks of every choice of blocks - radius runs of bits."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(runs, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_of(groups: list[np.ndarray], radius: int):
    """For each group of fingerprints, links (a, b) that span what is connected within the radius inside it."""
    for g in groups:
        left = g
        while len(left) > 1:
            root, frontier, left = left[0], left[:1], left[1:]
            while len(frontier) and len(left):
                near = np.zeros(len(left), bool)
                for at in range(0, len(frontier), 512):
                    near |= (np.bitwise_count(frontier[at : at + 512, None] ^ left[None, :]) <= radius).any(0)
                frontier, left = left[near], left[~near]
                for x in frontier:
                    yield root, x


def _bucket_links(radius: int):
    def run(batches):
        for b in batches:
            values = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(b.column(0).offsets.to_numpy())
            at = np.cumsum(sizes) - sizes
            two = at[sizes == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count(x ^ y) <= radius
            more = list(_links_of([values[s : s + n] for s, n in zip(at, sizes) if n > 2], radius))
            a = np.concatenate((x[near], np.array([m[0] for m in more], np.uint64)))
            c = np.concatenate((y[near], np.array([m[1] for m in more], np.uint64)))
            pairs = np.unique(np.stack((a, c), 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])

    return run


def _hot_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links among hot(fp): every fingerprint within radius / 2 bits of a point links to the least one there."""
    flips = [0, *(_signed(sum(1 << i for i in c)) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k))]
    near = hot.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("point"))
    least = near.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def hamming_links(distinct: DataFrame, radius: int = 4, blocks: int = 7, hot_size: int = HOT) -> DataFrame:
    """distinct(fp) -> (a, b): links whose closure is that of all pairs within the radius; copies of a pair may repeat."""
    if radius % 2 or not 0 < radius < blocks <= 16:
        raise ValueError("radius must be even and below blocks, and blocks at most 16")
    spark = distinct.sparkSession
    ship(spark)
    masks = block_masks(blocks, radius)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = checkpointed(dealt.groupBy("key").count().where(F.col("count") > hot_size).select("key"))
    n_hot = hot.count()
    sets = dealt
    if n_hot:
        sets = dealt.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left_anti")
    sets = sets.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    links = sets.mapInArrow(_bucket_links(radius), "a long, b long")
    if n_hot:
        far = dealt.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left_semi").select("fp").distinct()
        links = links.unionByName(_hot_links(checkpointed(far), radius))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int = 7, hot_size: int = HOT) -> DataFrame:
    """(doc_id, fp long, component_id), one row for each row of docs, repeated rows too.

    component_id is the smallest doc_id reachable over links, the row's own included. Null and empty texts have
    fingerprint zero and link like any other. Ids of null are no component's id: such a row takes the component of its
    fingerprint (null if only rows without id have that), and joins no components. Other columns of docs are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).where("id is not null"))
    found = connected_components(hamming_links(distinct.select("fp"), radius, blocks, hot_size))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    with_id = members.join(distinct, members["node"] == distinct["fp"]).select("fp", "root", "id")
    least = with_id.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n"))
    linked = look_up(with_id, least, "root", distinct.count()).select("fp", "component")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n")
    return look_up(fps, named, "fp", fps.count(), "left").select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

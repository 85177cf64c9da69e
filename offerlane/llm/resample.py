"""Importance resampling towards a target: draw the documents whose hashed n-grams are likelier in the target's texts.

A task holds the words of a chunk of texts as one array of ids and sorts its suffixes (to the depth of the longest n-gram;
no suffix crosses its text's end). Of the sorted suffixes, runs that share a prefix of n words are the occurrences of one
n-gram: each run is hashed once, and its bucket is scattered back to where the n-gram stands. The first pass adds buckets up
over all texts; the second scores each text with the buckets' gains. Nothing but the buckets' counts reaches the driver.

The draw is by Gumbel noise from a hash of the id, so it needs no state: the highest scores are a weighted sample. Scores
are counted in ranges; only rows from the range where the draw ends upwards are sorted, by ranges, so no task holds them all.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, chunks, ship, texts_of

LONGEST, BUCKETS = 1, 10_000
SEED, LEAST_WORDS, PER_CENT = 2024, 20, 10
#: Ranges in which scores are counted; their counts are all that the driver sees of them.
RANGES = 4_096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.translate(_LOWER))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ids in the order of their suffixes of at most depth words, and how many words each has in common with
    the one before. left says how many words each place has to its text's end."""
    n = len(ids)
    keys = []
    for j in range(depth):
        key = np.full(n, -1, np.int64)
        if j < n:
            key[: n - j] = ids[j:]
        key[left <= j] = -1  # a suffix that has ended comes first
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if depth == 1 else np.lexsort(keys[::-1])
    common, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for key in keys:
        k = key[order]
        same &= (k[1:] == k[:-1]) & (k[1:] >= 0)
        common[1:] += same
    return order, common


def buckets_of(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n, the bucket of the n-gram at each place (-1 where the text ends before), and the number of words a text."""
    parts = [words_of(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    words = [w for p in parts for w in p]
    if not words:
        return [np.empty(0, np.int64)] * longest, sizes
    ids = pd.factorize(np.array(words, object))[0]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    order, common = suffix_array(ids, left, longest)
    found = []
    for n in range(1, longest + 1):
        long_enough = left[order] >= n
        at = order[long_enough]
        # a run goes on as long as n words agree; suffixes that are too short stand before their run
        first = (common < n)[long_enough]
        first[:1] = True
        starts = np.flatnonzero(first)
        hashes = np.array([zlib.crc32(b" ".join(words[i : i + n])) % buckets for i in at[starts].tolist()], np.int64)
        own = np.full(len(words), -1, np.int64)
        own[at] = np.repeat(hashes, np.diff(np.append(starts, len(at))))
        found.append(own)
    return found, sizes


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task yields one row a bucket; these are summed by Spark."""
    ship(docs.sparkSession)

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                for own in buckets_of(texts[i:j], longest, buckets)[0]:
                    held += np.bincount(own[own >= 0], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # as many rows as there are buckets
        found[r["bucket"]] = r["n"]
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its share in the target over its share in the source, smoothed by one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            rows = [np.empty(0, np.int64)] * 3
            for i, j in chunks(texts):
                found, sizes = buckets_of(texts[i:j], longest, len(gains))
                ends = np.cumsum(sizes)
                features, weight = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                for own in found:
                    there = own >= 0
                    for total, each in ((features, there), (weight, np.where(there, gains[own], 0))):
                        sums = np.append(0, np.cumsum(each, dtype=np.int64))
                        total += sums[ends] - sums[ends - sizes]
                rows = [np.concatenate(x) for x in zip(rows, (sizes, features, weight))]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, eligible: Column, per_cent: int = PER_CENT) -> DataFrame:
    """scored(doc_id, score, ...) with rank: 1, 2, ... for the per_cent hundredths of the eligible rows that have the highest
    scores (ties to the smaller doc_id, null ids last), null for all others. scored has to be written, as it is read twice."""
    facts = scored.where(eligible).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    wanted = facts["n"] * per_cent // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return none
    width = (facts["high"] - facts["low"]) // RANGES + 1
    counted = scored.where(eligible).groupBy(F.floor((F.col("score") - facts["low"]) / width).alias("r")).count()
    bound, held = facts["low"], 0
    for r in sorted(counted.collect(), reverse=True):  # RANGES rows at most
        held += r["count"]
        if held >= wanted:
            bound = facts["low"] + int(r["r"]) * width
            break
    upper = eligible & (F.col("score") >= bound)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_nth")]
    # many rows of one score and id are told apart by their place, so that ranges can be even
    high = checkpointed(scored.where(upper).withColumn("_nth", F.monotonically_increasing_id()))
    dealt = checkpointed(high.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_part").count().collect()):  # as many rows as partitions
        offsets.append((r["_part"], before))
        before += r["count"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    ranked = dealt.join(offsets, "_part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(none.where(~F.coalesce(upper, F.lit(False))))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row for each row of docs, repeated rows too (each is drawn or
    not by itself; copies with one id have one score). A null text has no words and no features. A text is whole, however
    long; a chunk of a task holds one megabyte of texts, or one longer text. An empty target gives gains of the smoothing
    alone; empty docs give an empty table. Other columns of docs aren't read."""
    gains = gains_of(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    scored = weighed(docs, gains, id_col, text_col, longest)
    scored = checkpointed(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return drawn(scored, F.col("n_words") >= least_words, per_cent)

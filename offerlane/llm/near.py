"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

Candidates come from the SimHash blocks (fingerprints within 4 bits) and from 40 further fingerprints a text, each of the
least values of 6 hashes over its shingles: two texts of similarity s agree on one with a chance of s^6, so of the pairs at
0.8 five in a million meet under no key, and fewer the more alike they are. Only pairs whose shingle sets, compared whole,
are similar enough link.

Texts under one key are all compared while they are few. Of more, all are compared with two, the most central ones:
those that stand under the most and largest keys. Texts that this leaves in another component than most texts of their
key are then compared with all of other components there, but for texts that can't be similar enough: shingles that no
other text under large keys has bound how much a text can share. These comparisons are made in cells, each of two parts of
a key's texts, so no key's texts are ever gathered in one row or task, and pairs aren't rows. Keys that share texts are dealt
as one where that sends on fewer texts, so a group of near copies under many keys isn't dealt again for each of them.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm import simhash
from offerlane.llm.common import checkpointed, look_up, one_row, shared_dir, ship, texts_of
from offerlane.llm.components import connected_components

#: Four of five, as whole numbers.
SIMILARITY = (4, 5)
KEYS, LEAST = 40, 6
#: Texts under one key that are all compared, and those that are compared with all of a larger key.
FEW, HUBS = 16, 2
#: Texts of a large key in a part; a task compares those of two parts.
PART = 192
#: Large keys whose facts are broadcast to their rows (40 bytes each); more are joined. Bytes of texts that are broadcast.
BROADCAST_KEYS, BROADCAST_TEXTS = 300_000, 32 << 20
#: Texts that are looked up whose keys are broadcast (48 bytes each).
BROADCAST_NODES = 500_000
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (4, KEYS * LEAST), np.uint64)
_FLIP, _FACTOR, _MIX = _SEEDS[0], _SEEDS[1] | np.uint64(1), (_SEEDS[2] | np.uint64(1)).reshape(KEYS, LEAST)
_STEP = 512


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted. Words are those of simhash.fingerprint; a text with fewer is one shingle."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(ws[i : i + words]), 42) for i in range(max(1, len(ws) - words + 1))], np.uint64))


def keys_of(s: np.ndarray) -> np.ndarray:
    """The KEYS fingerprints of a set. All empty sets have the same."""
    least = np.full(KEYS * LEAST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _STEP):
        np.minimum(least, ((s[at : at + _STEP, None] ^ _FLIP) * _FACTOR).min(0), out=least)
    h = ((least.reshape(KEYS, LEAST) >> np.uint64(7)) * _MIX).sum(1, dtype=np.uint64) + _SEEDS[3][:KEYS]
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """A row for each distinct text: sha, best (no_id, id), n, fp, size (its shingles), keys."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(2))
            sets = [shingle_set(t, words) for t in texts]
            keys = np.concatenate([keys_of(x) for x in sets]) if texts else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * KEYS, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([simhash.fingerprint(t, words) for t in texts], pa.int64()), pa.array(map(len, sets), pa.int64()), lists], ["sha", "id", "fp", "size", "keys"])

    rows = docs.select(text_sha(text_col).alias("sha"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, "sha binary, id long, fp long, size long, keys array<long>")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("fp", "size", "keys")))


def text_sha(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _all_pairs(batches):
    for b in batches:
        for nodes in b.column(0).to_pylist():
            yield from _pairs(list(combinations(sorted(nodes), 2)))


def _pairs(pairs: list):
    if pairs:
        a = np.array(pairs, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])


class Texts:
    """The texts of nodes(sha, node), read from docs. Copies of a text are equal, so any row of it will do."""

    def __init__(self, docs: DataFrame, text_col: str, nodes: DataFrame):
        self.rows = docs.select(text_sha(text_col).alias("sha"), F.col(text_col).alias("text"))
        self.shas = nodes.select("sha", "node")

    def of(self, wanted: DataFrame) -> DataFrame:
        """wanted(node, n) -> (node, n, text), written: only wanted texts are shuffled, once, where there are few of them."""
        wanted = checkpointed(self.shas.join(wanted, "node"))
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
        return checkpointed(self.rows.join(wanted, "sha").groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text")))


def _may_be_similar(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs(a, b) whose numbers of shingles don't rule it out."""
    a, b = sizes.select(F.col("node").alias("a"), F.col("size").alias("x")), sizes.select(F.col("node").alias("b"), F.col("size").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(SIMILARITY[1] * F.least("x", "y") >= SIMILARITY[0] * F.greatest("x", "y")).select("a", "b")


def _verified(pairs: DataFrame, texts: Texts, words: int) -> DataFrame:
    """Of pairs(a, b), those whose texts are similar. The end that stands in more pairs comes last: its text is broadcast
    where it is a hub's, so that rows with a text aren't shuffled for it."""
    pairs = checkpointed(pairs)
    degree = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    found = texts.of(degree)
    ends = pairs
    total = 2 * pairs.count()
    for side in ("a", "b"):
        ends = ends.join(degree.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side)
    first = F.col("n_a") <= F.col("n_b")
    ends = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    told = ends.join(found.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
    told = look_up(told, found.select(F.col("node").alias("y"), "n", F.col("text").alias("text_y")), "y", total, bytes_of=F.octet_length("text_y"), most=BROADCAST_TEXTS)

    def run(batches):
        sets = lru_cache(64)(lambda t: shingle_set(t, words))
        for b in batches:
            near = [similar(sets(x), sets(y)) for x, y in zip(texts_of(b.column(2)), texts_of(b.column(3)))]
            yield b.select([0, 1]).rename_columns(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return checkpointed(told.select("x", "y", "text_x", "text_y").mapInArrow(run, "a long, b long"))


def _unique(texts: DataFrame, words: int) -> DataFrame:
    """texts(node, text) -> (node, u): how many of a text's shingles no other text has, where there are any."""

    def run(batches):
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                own = shingle_set(t, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own.view(np.int64))], ["node", "shingle"])

    once = texts.select("node", "text").mapInArrow(run, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("df"))
    return once.where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))


def _told(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """rows with the other columns of facts(key, n, ...): broadcast where there are few large keys, else looked up."""
    return rows.join(F.broadcast(facts.drop("n")), "key") if few else look_up(rows, facts, "key", rows.count()).drop("n")


def _few_pairs(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """All pairs of the nodes under keys that few share."""
    small = dealt.join(large.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list("node").alias("nodes"))
    return small.where(F.size("nodes") > 1).select("nodes").distinct().mapInArrow(_all_pairs, "a long, b long")


def _hub_pairs(under: DataFrame, few: bool) -> DataFrame:
    """under(key, node, n): each node with the most central nodes of its key."""
    weight = under.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = under.join(weight, "node").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node")))
    hubs = ranked.where(F.col("rank") <= HUBS).groupBy("key").agg(F.max("n").alias("n"), F.collect_list("node").alias("hubs"))
    met = _told(under.select("key", "node"), hubs, few).select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _strays(under: DataFrame, roots: DataFrame, sizes: DataFrame, texts: Texts, words: int, few: bool) -> DataFrame:
    """under(key, node) -> (key, n, node, root, size, shared, stray): of keys whose nodes have several roots, the nodes that
    may be similar enough to another of the key. stray: not of the root that most have. n: such nodes of the key."""
    rooted = checkpointed(under.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    most = parts.groupBy("key").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n")).where("parts > 1")
    split = checkpointed(_told(rooted, most.select("key", "n", F.col("top.root").alias("top")), few))
    nodes = split.select("node").distinct()
    facts = nodes.join(sizes, "node").join(_unique(texts.of(nodes.select("node", F.lit(1).alias("n"))), words), "node", "left").select("node", "size", (F.col("size") - F.coalesce("u", F.lit(0))).alias("shared"))
    split = checkpointed(split.join(facts, "node"))
    least = split.groupBy("key").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("n"))
    # 5 both >= 4 (a + b - both), and both is at most what either may share
    split = _told(split, least, few).where(9 * F.col("shared") >= 4 * (F.col("size") + F.col("least")))
    split = checkpointed(split.select("key", "node", "root", "size", "shared", (F.col("root") != F.col("top")).alias("stray")))
    held = split.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stray").cast("long")).alias("strays")).where("n > 1 and strays > 0")
    return _told(split, held.select("key", "n", F.col("n").alias("held")), few).select("key", F.col("held").alias("n"), "node", "root", "size", "shared", "stray")


def _joined_keys(strays: DataFrame) -> DataFrame:
    """strays, where keys that share texts are one key if that puts texts into fewer cells than these keys by themselves do.
    All texts that met still meet, and a text is a stray if it is one under any of the keys."""
    total = strays.count()
    vertex = F.col("key").bitwiseOR(F.lit(-1 << 63))  # nodes aren't negative
    at = f"{shared_dir(strays.sparkSession)}/strays-{uuid.uuid4().hex}"
    strays.select(vertex.alias("a"), F.col("node").alias("b")).write.parquet(at)  # what Spark knows of a checkpoint's values fails in the rounds' unions
    found = connected_components(strays.sparkSession.read.parquet(at))
    keys = strays.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("vertex", vertex)
    keys = checkpointed(keys.join(found.select(F.col("node").alias("vertex"), "root"), "vertex", "left").select("key", "n", F.coalesce("root", "vertex").alias("block")))
    dealt = lambda n: n * F.ceil(n / PART)
    nodes = look_up(strays.select("key", "node"), keys, "key", total).select("block", "node").distinct()
    nodes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("nodes"))
    fewer = nodes.join(keys.groupBy("block").agg(F.sum(dealt(F.col("n"))).alias("apart")), "block").where(dealt(F.col("nodes")) < F.col("apart"))
    told = checkpointed(look_up(strays.drop("n"), keys.join(fewer.select("block", "nodes"), "block", "left"), "key", total))
    facts = [F.first(c).alias(c) for c in ("root", "size", "shared")]
    one = told.where("nodes is not null").groupBy("block", "node").agg(F.first("nodes").alias("n"), *facts, F.max("stray").alias("stray"))
    return told.where("nodes is null").select(*strays.columns).unionByName(one.withColumnRenamed("block", "key").select(*strays.columns))


def _stray_links(strays: DataFrame, texts: Texts, words: int) -> DataFrame:
    """(a, b): similar texts of one key and of different roots, one of them a stray. The texts of a key are dealt to parts of
    about PART; each two parts (and each by itself) meet in a cell, a text in as many cells as its key has parts. Pairs are
    made within a cell only, so neither they nor texts for them are ever rows."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = checkpointed(_joined_keys(strays)).withColumn("part", F.pmod(F.xxhash64("node", "key"), parts).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = dealt.select(F.xxhash64("key", F.least("part", "meets"), F.greatest("part", "meets")).alias("cell"), "node", "root", "size", "shared", "stray", "part")
    wanted = cells.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    told = cells.join(texts.of(wanted).select("node", "text"), "node").select("cell", "node", "root", "size", "shared", "stray", "part", "text")

    def run(group: pa.Table) -> pa.Table:
        node, root, size, shared, stray, part = (group.column(c).to_numpy() for c in ("node", "root", "size", "shared", "stray", "part"))
        sets = [shingle_set(t, words) for t in texts_of(group.column("text").combine_chunks())]
        both = _common(sets)
        able = (root[:, None] != root) & (stray[:, None] | stray) & (SIMILARITY[1] * both >= SIMILARITY[0] * (size[:, None] + size - both))
        x, y = np.nonzero(np.triu(able, 1))
        return pa.table([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    return checkpointed(told.groupBy("cell").applyInArrow(run, "a long, b long").distinct())


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common, by products of 0/1 matrices over a slice of the shingles at a time."""
    n, sizes = len(sets), [len(x) for x in sets]
    out = np.zeros((n, n), np.int64)
    values, which, count = np.unique(np.concatenate(sets) if n else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    of, alone = np.repeat(np.arange(n), sizes), count < 2
    np.add.at(out, (np.arange(n), np.arange(n)), np.bincount(of[alone[which]], minlength=n))
    column = np.cumsum(~alone) - 1
    shared = ~alone[which]
    of, at = of[shared], column[which[shared]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for low in range(0, int((~alone).sum()), _STEP * 8):
        x, y = np.searchsorted(at, [low, low + _STEP * 8])
        m = np.zeros((n, _STEP * 8), np.float32)
        m[of[x:y], at[x:y] - low] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def without_near_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, and of each group of texts that links connect exactly one row: that of the smallest id,
    null ids last. Rows without id are kept and dropped like others. Texts without words are copies of each other."""
    ship(docs.sparkSession)
    nodes = checkpointed(_sketches(docs, id_col, text_col, words).select("*", F.monotonically_increasing_id().alias("node")))
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = simhash.hamming_links(by_fp.select("fp")).join(by_fp.withColumnsRenamed({"fp": "a", "least": "x"}), "a").join(by_fp.withColumnsRenamed({"fp": "b", "least": "y"}), "b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    large = checkpointed(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW))
    few = (n_large := large.count()) <= BROADCAST_KEYS
    large = F.broadcast(large) if few else large
    pairs = _few_pairs(dealt, large).unionByName(same).unionByName(close)
    under = checkpointed(dealt.join(large, "key")) if n_large else None
    if n_large:
        pairs = pairs.unionByName(_hub_pairs(under, few))
    texts = Texts(docs, text_col, nodes)
    links = _verified(_may_be_similar(pairs.distinct(), nodes.select("node", "size")), texts, words)
    roots = connected_components(links)
    if n_large:
        strays = checkpointed(_strays(under, roots, nodes.select("node", "size"), texts, words, few))
        if not strays.isEmpty():
            roots = connected_components(links.unionByName(_stray_links(strays, texts, words)))
    whole = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = whole.agg(F.min(F.struct("best", "sha")).alias("first"), F.sum("n").alias("n")).select("first.*", "n")
    kept = kept.select(F.struct("sha", "best.id").alias("mark"), "n")
    return one_row(docs, F.struct(text_sha(text_col).alias("sha"), F.col(id_col).cast("long").alias("id")), kept)

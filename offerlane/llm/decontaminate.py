"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

Texts and items are words (lower-cased runs of ASCII letters, digits and non-ASCII characters) and five-word shingles. A
shingle weighs the more, the fewer items have it; one that an item doesn't have weighs as the rarest do. A window of a
document is as long as an item, and the exact weighted Jaccard similarity of the shingle multisets decides.

Two bounds, which lose no window, say where windows are laid. A window similar to an item holds one of the item's rarest
shingles, those that make up more than a fifth of its weight; so a phrase that many items share lays none. And the weight
of its shingles that no item has is at most a quarter of that of the others. The SimHash of each such window fetches,
through tables of 16-bit blocks, all items of the window's length whose fingerprint lies within the radius.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, chunks, flat, run_hashes, runs_of, ship, texts_of
from offerlane.llm.licenses import WORD_BYTES

WORDS = 5
SIMILARITY = 0.8
#: Bits. A similarity of 0.8 leaves about 10 of 64 different, with a deviation of 3; the README has the recall.
RADIUS = 19
#: Of four blocks of 16 bits one differs in at most a quarter of the radius.
_BLOCKS, _NEAR = 4, RADIUS // 4
#: Bytes of item texts that go to every task at once; a larger benchmark goes in blocks of so many, one after the other.
ITEM_BYTES = 4 << 20
#: Windows whose fingerprints are made at once.
_STEP = 2048
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_BALL = np.array([sum(1 << b for b in c) for n in range(_NEAR + 1) for c in combinations(range(16), n)], np.uint16)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and where each text's words end. Words are those of words_of()."""
    body, ends = flat([t.lower().encode().translate(WORD_BYTES) + b" " for t in texts])
    begins, stops = runs_of(body == 32)
    return run_hashes(body, begins, stops), np.searchsorted(begins, ends)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ (hashes[i : i + n] * _FACTORS[i])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _signs(h: np.ndarray) -> np.ndarray:
    return 2.0 * np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is set where its weighted sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in a sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return at, table[at] == values if len(table) else np.zeros(len(values), bool)


class Prints:
    """Fingerprints of the items of one length, and the tables of their blocks."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        blocks = prints.astype("<u8").view(np.uint16).reshape(-1, _BLOCKS)
        self.order = np.argsort(blocks, axis=0, kind="stable")
        self.sorted = np.take_along_axis(blocks, self.order, 0)

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """All items within the radius."""
        some = []
        for b, value in enumerate(np.array([fingerprint], "<u8").view(np.uint16)):
            held = self.sorted[:, b]
            if len(held) <= len(_BALL):
                some.append(self.order[np.bitwise_count(held ^ value) <= _NEAR, b])
                continue
            begins, ends = np.searchsorted(held, value ^ _BALL, "left"), np.searchsorted(held, value ^ _BALL, "right")
            hit = ends > begins
            some += [self.order[x:y, b] for x, y in zip(begins[hit].tolist(), ends[hit].tolist())]
        some = np.unique(np.concatenate(some)) if some else np.empty(0, np.int64)
        return self.items[some[np.bitwise_count(self.prints[some] ^ fingerprint) <= RADIUS]]


class Shape:
    """The items with shingles of k words: weights, rarest shingles, and Prints by length."""

    def __init__(self, k: int, items: list[tuple[int, int, np.ndarray]], weights: dict[int, float]):
        self.k = k
        self.known = np.unique(np.concatenate([h for _, _, h in items]))
        self.weight = np.array([weights[s] for s in self.known.tolist()])
        anchors, by_length = set(), {}
        for i, n_words, h in items:
            own, n = np.unique(h, return_counts=True)
            w = self.weight[np.searchsorted(self.known, own)]
            rarest = np.lexsort((own, -w))
            sums = np.cumsum((n * w)[rarest])
            first = int(np.searchsorted(sums, (1 - SIMILARITY) * sums[-1] * (1 + 1e-9), side="right")) + 1
            anchors |= {(s, n_words) for s in own[rarest[:first]].tolist()}
            print_ = _packed((self.weight[np.searchsorted(self.known, h)] @ _signs(h))[None, :])[0]
            by_length.setdefault(n_words, []).append((i, print_))
        pairs = np.array(sorted(anchors), np.uint64)
        self.anchors, begins = np.unique(pairs[:, 0], return_index=True)
        self.lengths, self.edges = pairs[:, 1].astype(np.int64), np.append(begins, len(pairs))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.anchors & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = {n: Prints(np.array([i for i, _ in x]), np.array([p for _, p in x], np.uint64)) for n, x in by_length.items()}

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a rarest shingle stands, and which."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        which, there = _find(self.anchors, h[at])
        return at[there], which[there]

    def starts(self, at: np.ndarray, which: np.ndarray, n: int):
        """For each length, the runs of starts whose windows hold a rarest shingle of an item of that length; a document
        of n words that is shorter than the item is one window."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for p, a in zip(at.tolist(), which.tolist()):
            for length in self.lengths[self.edges[a] : self.edges[a + 1]].tolist():
                last = max(0, n - length)
                spans.setdefault(length, []).append((max(0, min(p - length + self.k, last)), min(p, last) + 1))
        for length, own in sorted(spans.items()):
            begin, end = own[0]
            for x, y in own[1:]:  # in order, as the places are
                if x > end:
                    yield length, begin, end
                    begin = x
                end = max(end, y)
            yield length, begin, end

    def windows(self, h: np.ndarray, length: int, begin: int, end: int, rare: float):
        """Of the windows that start in a run, those that can be similar to an item: (start, fingerprint)."""
        size = min(max(1, length - self.k + 1), len(h))
        for a in range(begin, end, _STEP):
            z = min(a + _STEP, end)
            mine = h[a : z - 1 + size]
            at, there = _find(self.known, mine)
            w = np.where(there, self.weight[at], rare)
            sums = lambda x: (c := np.concatenate((np.zeros_like(x[:1]), np.cumsum(x, 0))))[size:] - c[:-size]
            known, all_ = sums(np.where(there, w, 0)), sums(w)
            some = np.flatnonzero(known >= SIMILARITY * all_ * (1 - 1e-9))
            if len(some):
                prints = _packed(sums(w[:, None] * _signs(mine))[some])
                yield from zip((a + some).tolist(), prints)


class Items:
    """The benchmark's side, or that of a block of it. n items in all, of which df[s] have a shingle s."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int | None = None, df: dict[int, int] | None = None):
        self.ids, self.held, by_k = [], [], {}
        for item_id, text in rows:
            w, _ = word_hashes([text or ""])
            if len(w):
                k = min(WORDS, len(w))
                h = shingles(w, k)
                by_k.setdefault(k, []).append((len(self.ids), len(w), h))
                self.ids.append(item_id)
                self.held.append(h)
        df = df or Counter(s for h in self.held for s in set(h.tolist()))
        n = n or len(self.ids)
        self.rare = float(np.log1p(max(n, 1)))
        self.weight = {s: float(np.log1p(n / df[s])) for h in self.held for s in h.tolist()}
        self.shapes = [Shape(k, x, self.weight) for k, x in sorted(by_k.items())]

    def similarity(self, counts: Counter, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's."""
        theirs, w = Counter(self.held[item].tolist()), self.weight
        both = sum(min(n, theirs[s]) * w[s] for s, n in counts.items() if s in theirs)
        mine = sum(n * (w[s] if s in theirs else self.rare) for s, n in counts.items())
        return both / (mine + sum(n * w[s] for s, n in theirs.items()) - both)

    def search_all(self, hashes: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple]]:
        """Of several documents whose words follow each other, the best window for each item: (item_id, first word, words,
        similarity). Items of one id count as one."""
        found: dict[tuple, tuple] = {}
        begins = np.append(0, ends[:-1])
        for shape in self.shapes:
            h = shingles(hashes, shape.k)
            at, which = shape.hits(h)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + shape.k <= ends[doc]
            at, which, doc = at[inside], which[inside], doc[inside]
            edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for x, y in zip(edge, edge[1:]):
                d = int(doc[x])
                begin, n = int(begins[d]), int(ends[d] - begins[d])
                own = h[begin : begin + n - shape.k + 1]
                for length, first, last in shape.starts(at[x:y] - begin, which[x:y], n):
                    size = max(1, length - shape.k + 1)
                    for start, fingerprint in shape.windows(own, length, first, last, self.rare):
                        near = shape.prints[length].near(fingerprint).tolist()
                        counts = Counter(own[start : start + size].tolist()) if near else None
                        for i in near:
                            if (s := self.similarity(counts, i)) >= SIMILARITY:
                                key, hit = (d, self.ids[i]), (s, -start, min(length, n - start))
                                found[key] = max(hit, found.get(key, hit))
        out: dict[int, list[tuple]] = {}
        for (d, item), (s, start, n) in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
            out.setdefault(d, []).append((item, -start, n, s))
        return out


def _shingles_of(rows: DataFrame) -> DataFrame:
    """rows(text) -> (shingle), once for each row that has it; and how many rows have words."""

    def run(batches):
        for b in batches:
            for t in texts_of(b.column(0)):
                w, _ = word_hashes([t.decode("utf-8")])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(w, min(WORDS, max(1, len(w))))).view(np.int64))], ["shingle"])

    return rows.select("text").mapInArrow(run, "shingle long")


def _blocks(items: DataFrame, id_col: str, text_col: str, item_bytes: int) -> list[Callable[[], Items]]:
    """The benchmark in blocks of bounded bytes, each read when it is called for. How many follows from its total size;
    weights are counted over the whole of it. Copies of an item count once."""
    ship(items.sparkSession)
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    collected = lambda part: [tuple(r) for r in part.orderBy("item_id", "text").collect()]
    if total <= item_bytes:
        return [lambda: Items(collected(rows))] if total else []
    n = -(-2 * total // item_bytes)
    rows = checkpointed(rows)
    df = checkpointed(_shingles_of(rows).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")))
    n_items = rows.select("text").mapInArrow(_with_words, "n long").agg(F.sum("n").alias("n")).first()["n"]

    def block(i: int) -> Items:
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        own = _shingles_of(part).distinct().join(df, "shingle").toPandas()  # as many rows as the block has shingles
        return Items(collected(part), n_items, dict(zip(own["shingle"].to_numpy(np.int64).view(np.uint64).tolist(), own["n"].tolist())))

    return [partial(block, i) for i in range(n)]


def _with_words(batches):
    for b in batches:
        n = sum(len(word_hashes([t.decode("utf-8")])[0]) > 0 for t in texts_of(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


_HITS = "array<struct<item_id: bigint, first_word: bigint, n_words: bigint, similarity: double>>"


def _hits(items: Items):
    @F.pandas_udf(_HITS)
    def hits(texts: pd.Series) -> pd.Series:
        values, out = [t or "" for t in texts], []
        for a, b in chunks(values):
            found = items.search_all(*word_hashes(values[a:b]))
            out += [[{"item_id": i, "first_word": s, "n_words": n, "similarity": x} for i, s, n, x in found.get(d, ())] for d in range(b - a)]
        return pd.Series(out)

    return hits


_HIT = "row long, doc_id long, item_id long, first_word long, n_words long, similarity double"


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): for each document and each item found in it, its best window,
    and of equal ones the first.

    Only contaminated documents have rows; null and empty texts, and items without words, match nothing. A repeated row
    of docs gives repeated rows; repeated items count as one of the same id, items without id as one without id. Empty
    tables give no rows. Other columns aren't read. Documents are read once for each block of the benchmark, in place,
    and aren't shuffled; where there are several blocks, what they find is written and merged.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    search = lambda block: rows.select("row", "doc_id", F.explode(_hits(block)(F.col("text"))).alias("hit")).select("row", "doc_id", "hit.*")
    blocks = _blocks(items, item_col, item_text_col, item_bytes)
    if not blocks:
        return docs.sparkSession.createDataFrame([], _HIT).drop("row")
    if len(blocks) == 1:
        return search(blocks[0]()).drop("row")
    found = reduce(DataFrame.unionByName, [checkpointed(search(block())) for block in blocks])
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.at")).alias("first_word"), "b.n_words", "b.similarity")


def without_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs, with all their columns, without the documents in which an item is found: repeated rows and rows without id
    are judged like others. With several blocks of the benchmark, what is left is written after each."""
    for i, block in enumerate(_blocks(items, "item_id", "text", item_bytes)):
        docs = (checkpointed(docs) if i else docs).where(F.size(_hits(block())(F.col(text_col))) == 0)
    return docs

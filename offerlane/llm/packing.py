"""Packing token sequences by cutting-stock column generation.

A document's tokens are cut into whole sequences and a remainder. The remainders' lengths form a histogram of fewer than
`size` bins, gathered from all documents. Over it, a linear program chooses how often each pattern (a multiset of lengths
that fits a sequence) is used; a knapsack dynamic program prices new patterns, many a round, until the sum is close to
its bound. Patterns are used floor(x) times, what rounding leaves is packed by whole numbers, and the documents of each
length, ranked without ever meeting in one task, take their slots.

Few patterns fill a sequence to the last token. The fewest sequences whose documents make up for all gaps, those with the
widest gaps, are given up; their documents are laid end to end, by distributed prefix sums, and cut to fill the gaps of
the others. What is then left is less than two sequences; it is cut too, the last part into powers of two. So no sequence
needs padding, and nearly all remainders stay whole.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, look_up, ship, texts_of
from offerlane.llm.tokens import VOCABULARY, crc32_of, encoded, vocabulary_path

SIZE = 1024
END = b"\0\0\0\0"  # id 0 ends each document
#: The linear program may stop where it is proven to be within this share of its least sum, or within so many sequences
#: a length (less than rounding loses), or where WINDOW rounds gained less than GAIN.
CLOSE, ROUNDED, GAIN, WINDOW = 5e-4, 3e-3, 2e-4, 10
#: Patterns that a round of pricing brings, and exchanges between rounds, at most.
COLUMNS, EXCHANGES = 150, 100
#: Documents in a bucket in which sums are counted one after the other; buckets in which the ranks of a length are;
#: buckets whose sums are added up at once.
BUCKET, RANKED, BLOCK = 2048, 4, 4096
#: Documents given up whose keys are broadcast (24 bytes each); more are joined.
BROADCAST_ROWS = 500_000


def price(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack: values[l] is length l's (0: not there). For each room up to size the best total, and the
    length that was taken last (0: one of the room stays empty)."""
    gain = np.where(values > 0, values, -np.inf)[1:]
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        with_l = best[c - 1 :: -1][: len(gain)] + gain[:c]
        k = int(with_l.argmax()) if len(with_l) else 0
        best[c], took[c] = (with_l[k], k + 1) if len(with_l) and with_l[k] > best[c - 1] else (best[c - 1], 0)
    return best, took


def _filling(took: np.ndarray, room: int, width: int) -> np.ndarray:
    """How often each length is in the best filling of a room."""
    counts = np.zeros(width, np.int64)
    while room > 0:
        counts[took[room]] += 1
        room -= took[room] or 1
    counts[0] = 0
    return counts


def _greedy(lengths: np.ndarray, need: np.ndarray, size: int, whole: bool = False):
    """Patterns (counts, times): the longest length that is left, then what fits beside it, longest first, as often as the
    stock allows. Unless they are to be whole, each pattern uses up a length that later ones don't hold."""
    left, alive = need.copy(), need > 0
    while alive.any():
        stock = left if whole else np.maximum(left, 1e-9)
        p, room = np.zeros(len(lengths), need.dtype), size
        while len(fits := np.flatnonzero(alive & (lengths <= room) & (p < stock))):
            i = fits[-1]
            n = max(1, min(room // int(lengths[i]), int(stock[i] - p[i])))
            p[i] += n
            room -= n * int(lengths[i])
        times = np.where(p > 0, left / np.maximum(p, 1), np.inf)
        out = int(times.argmin())
        n = int(times[out]) if whole else times[out]
        left = np.maximum(left - n * p, 0)
        alive[out] = whole
        alive &= (left > 0) | (not whole)
        yield p, n


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def _exchange(inverse: np.ndarray, d: np.ndarray, out: int) -> np.ndarray:
    """The inverse, in place, after column `out` of the matrix has become the one that inverse @ column = d; its new row."""
    row = inverse[out] / d[out]
    some = np.flatnonzero(np.abs(d) > 1e-12)
    inverse[some] -= d[some, None] * row
    inverse[out] = row
    return row


def _inverse(columns: np.ndarray) -> np.ndarray:
    """By exchanges alone: threaded linear-algebra libraries were seen to hang in a driver's process."""
    m = len(columns)
    inverse, left, place = np.eye(m), np.ones(m, bool), np.zeros(m, np.int64)
    for j in range(m):
        there = np.flatnonzero(columns[:, j])
        d = _times(inverse[:, there], columns[there, j])
        place[j] = np.where(left, np.abs(d), -1).argmax()
        left[place[j]] = False
        _exchange(inverse, d, int(place[j]))
    return inverse[place]


def program(lengths: np.ndarray, need: np.ndarray, size: int, close: float = CLOSE, rounded: float = ROUNDED, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """Least sum(x) with columns @ x = need: (columns, x, a lower bound of the sum), by the revised simplex method with a
    pool of priced patterns. A little is added to each need, so that no two of them tie."""
    m = len(lengths)
    need = need * (1 + 1e-4 * np.random.default_rng(1).random(m))
    columns, x = np.zeros((m, m)), np.zeros(m)
    for j, (p, n) in enumerate(_greedy(lengths, need, size)):
        columns[:, j], x[j] = p, n
    inverse = _inverse(columns)  # it has one: each column holds a length that later ones don't
    bound, pool, seen, sums = float(lengths @ need) / size, np.zeros((0, m)), set(), [x.sum()]
    tie = 1e-7 * need.mean()
    while x.sum() - bound > max(close * bound, rounded * m):
        y = inverse.sum(0)
        values = np.zeros(size + 1)
        values[lengths] = np.maximum(y, 0)
        best, took = price(values[:size], size)
        bound = max(bound, float(values[lengths] @ need) / max(best[size], 1))
        with_l = values[lengths] + best[size - lengths]
        if best[size] <= 1 + 1e-9 or (len(sums) > WINDOW and sums[-WINDOW - 1] - sums[-1] < gain * bound):
            break
        new = []
        for j in np.argsort(-with_l)[:COLUMNS]:
            counts = _filling(took, size - int(lengths[j]), size)[lengths]
            counts[j] += 1
            if with_l[j] > 1 + 1e-9 and counts.tobytes() not in seen:
                seen.add(counts.tobytes())
                new.append(counts)
        if new:
            pool = np.vstack((pool, np.array(new, float)))
        for _ in range(EXCHANGES):
            worth = _times(pool, y)
            j = int(worth.argmax())
            if worth[j] <= 1 + 1e-7:
                break
            there = np.flatnonzero(pool[j])
            d = _times(inverse[:, there], pool[j, there])
            falls = d > 1e-7
            ratio = np.where(falls, x / np.where(falls, d, 1), np.inf)
            least = np.flatnonzero(falls & (ratio <= ((x[falls] + tie) / d[falls]).min()))
            out = int(least[d[least].argmax()])
            step = max(ratio[out], 0)
            x = np.maximum(x - step * d, 0)
            x[out] = step
            row = _exchange(inverse, d, out)
            columns[:, out] = pool[j]
            y = y - (worth[j] - 1) * row
        sums.append(x.sum())
        if np.abs(_times(columns, x) - need).max() > 10 * tie:  # rounding errors add up
            inverse = _inverse(columns)
            x = np.maximum(_times(inverse, need), 0)
    return columns, x, bound


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """counts: how many remainders have a length. Patterns and how often each is used; together they use no length more
    often than it occurs. The documents that are in none are enough to fill the gaps."""
    lengths = np.array(sorted(x for x, n in counts.items() if n > 0 and 0 < x < size), np.int64)
    if not len(lengths):
        return []
    need = np.array([counts[x] for x in lengths], np.int64)
    columns, x, _ = program(lengths, need.astype(float), size)
    columns, used = np.rint(columns).astype(np.int64), np.floor(x + 1e-7).astype(np.int64)
    left, chosen = need.copy(), []
    for p in np.lexsort((np.arange(len(used)), -used)):
        column = columns[:, p]
        n = min(int(used[p]), int((left[column > 0] // column[column > 0]).min()))
        if n > 0:
            left = left - n * column
            chosen.append((column, n))
    chosen += list(_greedy(lengths, left, size, whole=True))
    gaps = sum(n * (size - int(p @ lengths)) for p, n in chosen)
    given_up = -(-gaps // size)  # each frees a sequence's tokens, and closes its own gap: a whole size
    result = []
    for p, n in sorted(chosen, key=lambda c: int(c[0] @ lengths)):
        out = min(n, given_up)
        given_up -= out
        if n > out:
            result.append(({int(a): int(b) for a, b in zip(lengths, p) if b}, n - out))
    return result[::-1]


def _slots(chosen: list[tuple[dict[int, int], int]], first_sequence: int, size: int) -> tuple[list[tuple], list[tuple], int]:
    """Rows (r, from_rank, to_rank, copies, first sequence, first offset): which slots the documents of a length take in
    order of their rank; (gap, sequences, first sequence) of the patterns with gaps; and the first sequence id after all."""
    taken: dict[int, int] = {}
    rows, gaps, sequence = [], [], first_sequence
    for pattern, n in chosen:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            at = taken.get(length, 0)
            rows.append((length, at, at + copies * n, copies, sequence, offset))
            taken[length] = at + copies * n
            offset += copies * length
        if offset < size:
            gaps.append((size - offset, n, sequence))
        sequence += n
    return rows, gaps, sequence


class Layout:
    """Where the tokens that are laid end to end go: into the gaps, one after the other, then into sequences of their own,
    the last of which is cut into powers of two."""

    def __init__(self, gaps: list[tuple], first_sequence: int, total: int, size: int):
        self.gaps, self.first, self.size = gaps, first_sequence, size
        self.begins = [0, *accumulate(gap * n for gap, n, _ in gaps)]
        self.own = total - self.begins[-1]
        if self.own < 0:
            raise ValueError("too few tokens for the gaps")
        self.tail = [self.own // size * size]
        self.tail += accumulate((1 << b for b in reversed(range(size.bit_length() - 1)) if self.own % size >> b & 1), initial=self.tail[0])

    def place(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset, how many tokens follow in the same place) of a position."""
        if at < self.begins[-1]:
            g = bisect_right(self.begins, at) - 1
            gap, _, sequence = self.gaps[g]
            nth, inside = divmod(at - self.begins[g], gap)
            return sequence + nth, self.size - gap + inside, gap - inside
        at -= self.begins[-1]
        if at < self.tail[0]:
            return self.first + at // self.size, at % self.size, self.size - at % self.size
        k = bisect_right(self.tail, at)
        return self.first + self.own // self.size + k - 2, at - self.tail[k - 1], self.tail[k] - at


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _before(sums: DataFrame, value: str, to: str) -> DataFrame:
    """(bucket, to): the sum of value over all buckets before, by sums of blocks of buckets and sums inside them."""
    block = F.expr(f"bucket div {BLOCK}").alias("block")
    inside = sums.select("bucket", value, block, (F.sum(value).over(Window.partitionBy(block).orderBy("bucket")) - F.col(value)).alias("inside"))
    blocks = sums.groupBy(block).agg(F.sum(value).alias("of"))  # a row for BLOCK buckets
    blocks = blocks.select("block", (F.sum("of").over(Window.orderBy("block")) - F.col("of")).alias("ahead"))
    return inside.join(F.broadcast(blocks), "block").select("bucket", (F.col("inside") + F.col("ahead")).alias(to))


def _bucketed(measured: DataFrame, n_docs: int, size: int) -> tuple[DataFrame, int, int]:
    """measured with r, q and bucket; the number of hash buckets, and the parts of each. Rows go by the hash of id and text;
    those that more than a bucket's worth of copies share are dealt over parts of the bucket."""
    buckets = max(1, -(-n_docs // BUCKET))
    rows = measured.select("*", (F.col("doc_tokens") % size).alias("r"), F.expr(f"doc_tokens div {size}").alias("q"), F.xxhash64("doc_id", "key").alias("h"), F.monotonically_increasing_id().alias("nth"))
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    most = copies.agg(F.max("n").alias("n")).first()["n"] or 0
    parts = max(1, -(-most // BUCKET))
    if parts > 1:
        rows = look_up(rows, copies, "h", n_docs, "left")
    else:
        rows = rows.withColumn("n", F.lit(None).cast("long"))
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("nth"), F.lit(parts))).otherwise(0)
    return rows.withColumn("bucket", F.pmod("h", F.lit(buckets)) * parts + part).drop("n", "h"), buckets, parts


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document, null and empty texts too (one token, id 0), and every repeated row is packed. Sequences are numbered
    from 0 without gaps; each is full, or a power of two long. Empty tables give no pieces; other columns aren't read.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))

    def measure(batches):
        path = vocabulary_path(name)
        for b in batches:
            tokens, crcs = [], []
            for ids in encoded(texts_of(b.column(1)), path):
                ids += END
                tokens.append(len(ids) // 4)
                crcs.append([crc32_of(ids[a : a + 4 * size]) for a in range(0, len(ids), 4 * size)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "key", "doc_tokens", "crcs"])

    measured = checkpointed(keyed.mapInArrow(measure, "doc_id long, key long, doc_tokens long, crcs array<long>"))
    rows, buckets, parts = _bucketed(measured, measured.count(), size)
    histogram = {r["r"]: r["count"] for r in rows.where("r > 0").groupBy("r").count().collect()}  # fewer rows than size
    whole = rows.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("n")).first()["n"]
    slots, gaps, next_sequence = _slots(patterns(histogram, size), whole, size)

    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "key", "nth")]
    rows = rows.withColumn("range", F.expr(f"bucket div {RANKED}"))
    by_length = rows.groupBy("r", "range").agg(F.count(F.lit(1)).alias("n"))
    before = by_length.select("r", "range", (F.sum("n").over(Window.partitionBy("r").orderBy("range")) - F.col("n")).alias("ranks_before"))
    q_before = _before(rows.groupBy("bucket").agg(F.sum("q").alias("n")), "n", "q_before")
    ranked = (
        rows.withColumn("rank_here", F.row_number().over(Window.partitionBy("r", "range").orderBy("bucket", *order)) - 1)
        .withColumn("q_here", F.sum("q").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
        .join(before, ["r", "range"])
        .join(q_before, "bucket")
        .select("doc_id", "key", "nth", "doc_tokens", "crcs", "r", "q", "bucket", (F.col("rank_here") + F.col("ranks_before")).alias("rank"), (F.coalesce("q_here", F.lit(0)) + F.col("q_before")).alias("first_whole"))
    )
    # fewer lengths than size in a pattern and at most three patterns a length: the slots are few whatever the input
    slot_rows = spark.createDataFrame(slots, "slot_r long, from_rank long, to_rank long, copies long, first_sequence long, first_offset long")
    fits = (F.col("r") == F.col("slot_r")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = checkpointed(ranked.join(F.broadcast(slot_rows), fits, "left"))

    wholes = placed.where("q > 0").select("doc_id", "doc_tokens", "first_whole", F.posexplode(F.slice("crcs", F.lit(1), F.col("q").cast("int"))).alias("k", "crc"))
    wholes = wholes.select("doc_id", (F.col("k") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first_whole") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    nth = F.col("rank") - F.col("from_rank")
    rests = placed.where("slot_r is not null").select(
        "doc_id",
        (F.col("q") * size).alias("start"),
        F.col("r").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - from_rank) div copies")).alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("copies")) * F.col("r")).alias("offset"),
    )
    over = placed.where("r > 0 and slot_r is null")
    # ranks follow the buckets, so documents without a slot have the last ones: texts of others needn't be read again
    first = over.agg(F.min(F.expr(f"bucket div {parts}")).alias("n")).first()["n"] or 0
    again = keyed.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)) >= first)
    return wholes.unionByName(rests).unionByName(_laid(over, again, gaps, name, size, next_sequence))


def _laid(over: DataFrame, keyed: DataFrame, gaps: list[tuple], name: str, size: int, first_sequence: int) -> DataFrame:
    """Pieces of the remainders in over, laid end to end and cut."""
    spark = over.sparkSession
    before = _before(over.groupBy("bucket").agg(F.sum("r").alias("n")), "n", "r_before")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "key", "nth")]
    here = F.sum("r").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    laid = over.select("doc_id", "key", "doc_tokens", "q", "r", "bucket", F.coalesce(here, F.lit(0)).alias("here")).join(before, "bucket")
    laid = checkpointed(laid.select("doc_id", "key", "doc_tokens", (F.col("q") * size).alias("start"), F.col("r").alias("length"), (F.col("here") + F.col("r_before")).alias("at")))
    totals = laid.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    if not totals["rows"]:
        return spark.createDataFrame([], _PIECES)
    layout = Layout(gaps, first_sequence, totals["tokens"], size)

    def again(batches):
        path = vocabulary_path(name)
        for b in batches:
            rests = [(ids + END)[len(ids + END) // (4 * size) * 4 * size :] for ids in encoded(texts_of(b.column(1)), path)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rests, pa.binary())], ["id", "text_key", "ids"])

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for doc_id, doc_tokens, start, length, at, ids in zip(*(b.column(i).to_pylist() for i in range(6))):
                a = 0
                while a < length:
                    sequence, offset, room = layout.place(at + a)
                    n = min(room, length - a)
                    out.append((doc_id, start + a, n, crc32_of(ids[4 * a : 4 * (a + n)]), doc_tokens, sequence, offset))
                    a += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(7)], names)

    keys = laid.select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")).distinct()
    keys = F.broadcast(keys) if totals["rows"] <= BROADCAST_ROWS else keys
    mine = keyed.join(keys, keyed["doc_id"].eqNullSafe(F.col("k_id")) & (keyed["key"] == F.col("k_key")), "left_semi")
    found = mine.select("doc_id", "text", "key").mapInArrow(again, "id long, text_key long, ids binary").groupBy("id", "text_key").agg(F.first("ids").alias("ids"))
    pieces = laid.join(found, laid["doc_id"].eqNullSafe(found["id"]) & (laid["key"] == found["text_key"]))
    return pieces.select("doc_id", "doc_tokens", "start", "length", "at", "ids").mapInArrow(cut, _PIECES)

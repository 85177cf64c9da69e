"""Removal of long repeats: bytes covered by a string of LENGTH bytes that also starts anywhere else.

Sorting all suffixes would move each byte LENGTH times, so the suffix array is sparse. Of every string of LENGTH bytes the
part of PART bytes with the least hash (the leftmost of equal ones) is its anchor: equal strings have their anchors at the
same place, so only the suffixes at anchors are sorted, about one in 70 bytes. An anchor's context is the stretch of all
strings that it anchors; a context that stands twice as it is says at once that all its strings repeat, and one whose part
stands once says that none does. Only contexts between these are sorted:

A task sorts the suffixes at its anchors (led by the hash of their part, followed by what stands before them, read
backwards) to a run, front-codes it (how many bytes are as in the suffix before, and the rest), and cuts it at the bounds
of ranges. A range's runs meet in one task, where a loser tree merges them; each node knows how many bytes its suffix has
in common with the last winner, so bytes that are known to be equal are never compared again. From the sorted order and
the common bytes follows, for each distance d of anchor and start, which contexts have d bytes before and LENGTH - d bytes
from the anchor on in common.

Groups of too many different contexts of one part don't meet in a task: their strings are counted by digest instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import CHUNK_BYTES, checkpointed, flat, look_up, run_hashes, ship, texts_of

LENGTH, PART = 200, 64
#: Contexts of one part that are compared in one task (some 300 bytes each), and bytes of contexts in a range.
GROUP, RANGE_BYTES = 30_000, 4 << 20
#: Tasks that merge runs, at most; more ranges share tasks.
PARTS = 20_000
#: One row in SAMPLE is asked for hot parts, which are dealt to SALTS; it decides where they are counted, not whether.
SAMPLE, HOT, SALTS = 64, 50_000, 512
#: Bytes of covers that are broadcast for texts with many copies.
BROADCAST_COVERS = 16 << 20
_PLACE = (1 << 28) - 1


def anchors(pieces: list[bytes], length: int, part: int) -> tuple[np.ndarray, ...]:
    """Of all strings of a length in the pieces, by anchor: where the first and the last of them start and where the anchor
    is (places in the joined pieces), and the hash of its part."""
    body, ends = flat(pieces)
    n = len(body)
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = np.arange(n - part + 1)
    h = run_hashes(body, at, at + part)
    least, size, width = (h & np.uint64(~_PLACE & (1 << 64) - 1)) | at.astype(np.uint64), 1, length - part + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    sizes = np.diff(ends, prepend=0)
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= np.repeat(ends, sizes)[: n - length + 1])
    q = (least[starts] & np.uint64(_PLACE)).astype(np.int64)
    edge = np.flatnonzero(np.diff(q, prepend=-1))
    return starts[edge], starts[np.append(edge[1:], len(starts)) - 1] if len(edge) else starts[:0], q[edge], h[q[edge]]


def _pieces(texts: list[bytes], length: int):
    """Groups of (text, offset, bytes) of about CHUNK_BYTES. A longer text is cut into overlapping pieces: then a context
    may end early, which costs a comparison but loses nothing."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK_BYTES):
            p = t[at : at + CHUNK_BYTES + length - 1] if len(t) > CHUNK_BYTES else t
            if len(p) < length:
                continue
            held.append((i, at, p))
            size += len(p)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
            if len(t) <= CHUNK_BYTES:
                break
    if held:
        yield held


def text_key(text_col: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)


def _anchored(docs: DataFrame, text_col: str, length: int, part: int) -> DataFrame:
    """(part, context, key, place): hashes of an anchor's part and of its context, the text's key, and the context's place:
    where it starts, how far the anchor is from there, and how many strings it has besides the first."""

    def run(batches):
        for b in batches:
            keys, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for some in _pieces(texts, length):
                pieces = [p for _, _, p in some]
                first, last, q, h = anchors(pieces, length, part)
                body = b"".join(pieces)
                context = [xxhash.xxh3_64_intdigest(body[x : y + length], z) for x, y, z in zip(first.tolist(), last.tolist(), (q - first).tolist())]
                ends = np.cumsum([len(p) for p in pieces])
                of = np.searchsorted(ends, first, "right")
                begins = np.append(0, ends[:-1]) - np.array([at for _, at, _ in some])
                place = (first - begins[of]) << 32 | (q - first) << 16 | (last - first)
                own = [keys[some[i][0]] for i in of.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64)), pa.array(own, pa.binary()), pa.array(place)], ["part", "context", "key", "place"])

    return docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length).mapInArrow(run, "part long, context long, key binary, place long")


def _shared(docs: DataFrame, text_col: str, length: int, part: int) -> DataFrame:
    """Anchors whose part stands more than once, written; alike says whether all its contexts are equal."""
    all_ = _anchored(docs, text_col, length, part)
    sample = checkpointed(_anchored(docs.where(F.rand(7) < 1 / SAMPLE), text_col, length, part).groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 7"))
    over = (sample.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT  # at most HOT parts have more
    hot = sample.where(F.col("n") > over).select("part")
    facts = F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    hot = checkpointed(all_.join(F.broadcast(hot), "part").groupBy("part").agg(*facts)).select("part", F.struct("n", "low", "high").alias("hot"))
    marked = all_.join(F.broadcast(hot), "part", "left")
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)))
    group = Window.partitionBy("part", "salt")
    seen = marked.withColumn("salt", salt).select("*", *(f.over(group).alias(c) for f, c in zip((F.count(F.lit(1)), F.min("context"), F.max("context")), ("n", "low", "high"))))
    told = lambda c: F.coalesce(F.col(f"hot.{c}"), F.col(c))
    return checkpointed(seen.where(told("n") > 1).select("part", "context", "key", "place", (told("low") == told("high")).alias("alike")))


def _cover(rows: DataFrame, length: int) -> DataFrame:
    """(key, first, last) of whole contexts: where the first and the last of their strings start."""
    first = F.shiftright("place", 32)
    return rows.select("key", first.cast("int").alias("first"), (first + F.col("place").bitwiseAND(0xFFFF)).cast("int").alias("last"))


def _context(text: bytes, place: int, length: int) -> tuple[bytes, bytes]:
    """What stands before the anchor, backwards, and what stands from it on."""
    first, left, span = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
    return text[first : first + left][::-1], text[first + left : first + span + length]


def common_bytes(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes a and b have in common at their start, of which `at` are known."""
    end = min(len(a), len(b))
    while at < end and a[at : at + 32] == b[at : at + 32]:
        at = min(at + 32, end)
    while at < end and a[at] == b[at]:
        at += 1
    return at


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as the number of bytes that each has in common with the one before, and its others."""
    same = [0] + [common_bytes(a, b) for a, b in zip(strings, strings[1:])]
    return same, [s[h:] for s, h in zip(strings, same)]


def merged(runs: list[tuple[list[int], list[bytes]]]):
    """The strings of front-coded sorted runs in order: (run, number in it, string, bytes in common with the one before).

    A loser tree. Each waiting string has with it how many bytes it has in common with the last string that left by its
    node. Of two, the one with more of these is less; only if they are equal are bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    strings: list[bytes | None] = [None] * k
    known, number = [0] * k, [0] * k
    for r, (_, rest) in enumerate(runs):
        strings[r] = rest[0] if rest else None
    loser = [0] * k

    def duel(x: int, y: int) -> tuple[int, int]:
        """(winner, loser), with what the loser has in common with the winner noted."""
        a, b = strings[x], strings[y]
        if b is None or a is None:
            return (x, y) if b is None else (y, x)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        h = common_bytes(a, b, known[x])
        less = a[h:] < b[h:] or (len(a) == len(b) == h and x < y)
        won, lost = (x, y) if less else (y, x)
        known[lost] = h
        return won, lost

    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = duel(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while strings[top] is not None:
        own, i = strings[top], number[top]
        yield top, i, own, known[top]
        same, rest = runs[top]
        number[top] = i = i + 1
        if i < len(rest):
            strings[top], known[top] = own[: same[i]] + rest[i], same[i]
        else:
            strings[top], known[top] = None, 0
        node = (k + top) // 2
        while node:
            top, loser[node] = duel(top, loser[node])
            node //= 2


def repeated(same: np.ndarray, lefts: list[bytes], sizes: np.ndarray, length: int, part: int) -> np.ndarray:
    """Of contexts in the order of their suffixes, which string (by distance d of anchor and start) stands in another too.
    same: bytes from the anchor on that each has in common with the one before; sizes: bytes it has from the anchor on."""
    n = len(lefts)
    order = sorted(range(n), key=lefts.__getitem__)
    before = np.array([0] + [common_bytes(lefts[a], lefts[b]) for a, b in zip(order, order[1:])], np.int64)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    long, near = np.array([len(x) for x in lefts]), length - sizes
    out = np.zeros((n, length - part + 1), bool)
    for d in range(length - part + 1):
        own = np.flatnonzero((near <= d) & (d <= long))
        if len(own) < 2:
            continue
        which = np.cumsum(same < length - d)[own] * n + np.cumsum(before < d)[back][own]
        _, place, count = np.unique(which, return_inverse=True, return_counts=True)
        out[own[count[place] > 1], d] = True
    return out


_RUN = "range int, same array<int>, rest array<binary>, left array<int>, key array<binary>, place array<long>, once array<boolean>"


def _sorted_runs(found: DataFrame, length: int, ranges: int) -> DataFrame:
    """found(key, text, wanted) -> front-coded runs of the wanted contexts, cut at the bounds of ranges."""

    def run(batches):
        for b in batches:
            entries = []
            for key, text, wanted in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
                for w in wanted:
                    left, right = _context(text, w["place"], length)
                    lead = w["part"] & (1 << 64) - 1
                    entries.append((lead.to_bytes(8, "big") + right + left, lead * ranges >> 64, len(left), key, w["place"], w["once"]))
            entries.sort(key=lambda e: e[0])
            rows, at = [], 0
            for i in range(1, len(entries) + 1):
                if i == len(entries) or entries[i][1] != entries[at][1]:
                    some, at = entries[at:i], i
                    same, rest = front_coded([e[0] for e in some])
                    rows.append({"range": some[0][1], "same": same, "rest": rest, "left": [e[2] for e in some], "key": [e[3] for e in some], "place": [e[4] for e in some], "once": [e[5] for e in some]})
            schema = pa.schema([("range", pa.int32()), ("same", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.int32())), ("key", pa.list_(pa.binary())), ("place", pa.list_(pa.int64())), ("once", pa.list_(pa.bool_()))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return found.select("key", "text", "wanted").mapInArrow(run, _RUN)


def _merge_runs(length: int, part: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        same, lefts, sizes, keys, places, once = [], [], [], [], [], []
        for r, i, s, h in merged([(x["same"], x["rest"]) for x in rows]):
            left = rows[r]["left"][i]
            same.append(h - 8)
            lefts.append(s[len(s) - left :])
            sizes.append(len(s) - 8 - left)
            keys.append(rows[r]["key"][i])
            places.append(rows[r]["place"][i])
            once.append(rows[r]["once"][i])
        hit = repeated(np.array(same), lefts, np.array(sizes), length, part) & np.array(once)[:, None]
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8))
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        at = np.array([p >> 32 for p in places], np.int64) + np.array([p >> 16 & 0xFFFF for p in places], np.int64)
        own = [keys[i] for i in row.tolist()]
        return pa.table([pa.array(own, pa.binary()), pa.array((at[row] - high + 1).astype(np.int32)), pa.array((at[row] - low).astype(np.int32))], names=["key", "first", "last"])

    return run


def _strings(found: DataFrame, length: int) -> DataFrame:
    """(string, key, first, once): the digest of each string of the wanted contexts."""

    def run(batches):
        for b in batches:
            for key, text, wanted in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
                at = np.concatenate([np.arange(w["place"] >> 32, (w["place"] >> 32) + (w["place"] & 0xFFFF) + 1) for w in wanted])
                once = np.concatenate([np.full((w["place"] & 0xFFFF) + 1, w["once"]) for w in wanted])
                shas = [xxhash.xxh3_128_digest(text[i : i + length]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array([key] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(once)], ["string", "key", "first", "once"])

    return found.select("key", "text", "wanted").mapInArrow(run, "string binary, key binary, first int, once boolean")


def _texts_of(docs: DataFrame, text_col: str, wanted: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """wanted(key, wanted) with one text of each key. Texts with many copies stay where they lie."""
    sized = checkpointed(wanted.join(copies, "key"))
    rows = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    found = look_up(rows, sized, "key", total, bytes_of=F.size("wanted") * 32, most=BROADCAST_COVERS)
    several = found.where("n > 1").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    return found.where("n = 1").select("key", "text", "wanted").unionByName(several)


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, part: int | None = None, group: int = GROUP) -> DataFrame:
    """(key, covers, n): for each text (told by its key) that has any, where runs of repeated strings start (first, last) and
    how many rows have the text."""
    ship(docs.sparkSession)
    part = part or max(1, min(PART, length // 3))
    shared = _shared(docs, text_col, length, part)
    copies = checkpointed(docs.select(text_key(text_col).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    mixed = shared.where("not alike").withColumn("which", F.struct("part", "context"))
    contexts = checkpointed(mixed.groupBy("part", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("of")))
    twice = contexts.where("n > 1").select(F.struct("part", "context").alias("which"), "n")
    whole = look_up(mixed.select("which", "key", "place"), twice, "which", shared.count())
    covers = _cover(shared.where("alike"), length).unionByName(_cover(whole, length))
    parts = contexts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("single")).where("single > 0")
    open_ = look_up(contexts.select("part", (F.col("n") == 1).alias("once"), "of"), parts, "part", contexts.count())
    open_ = checkpointed(open_.select("of.key", "part", "of.place", "once", (F.col("n") > group).alias("many")))
    for many in (False, True):
        own = open_.where(F.col("many") == many)
        if not (n := own.count()):
            continue
        wanted = own.groupBy("key").agg(F.collect_list(F.struct("part", "place", "once")).alias("wanted"))
        found = _texts_of(docs, text_col, wanted, copies, total)
        if many:
            strings = checkpointed(_strings(found, length))
            counted = checkpointed(strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            hit = look_up(strings, counted, "string", counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
            covers = covers.unionByName(hit.where("once").select("key", "first", F.col("first").alias("last")))
        else:
            ranges = max(docs.sparkSession.sparkContext.defaultParallelism, n * 2 * length // RANGE_BYTES + 1)
            runs = _sorted_runs(found, length, ranges).repartition(min(PARTS, ranges), "range")
            covers = covers.unionByName(runs.groupBy("range").applyInArrow(_merge_runs(length, part), "key binary, first int, last int"))
    held = covers.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("covers"))
    return held.join(copies, "key")


def kept(text: bytes, covers: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What stays of a text, and how many bytes in how many spans go."""
    out, at, gone, spans, end = [], 0, 0, 0, -1
    for first, last in sorted(covers):
        to = last + length
        if first > end:
            out.append(text[max(end, 0) : first])
            spans += 1
            gone += to - first
        elif to > end:
            gone += to - end
        end = max(end, to)
    out.append(text[max(end, 0) :])
    return b"".join(out), gone, spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, part: int | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row for each row of docs, repeated rows too (of two equal texts of
    `length` bytes or more nothing stays). kept is bytes, as a repeat may begin and end inside a character. Null counts as
    empty. Texts are whole: longer ones than CHUNK_BYTES are read in overlapping pieces. Empty docs give an empty table;
    other columns aren't read."""
    found = checkpointed(repeats(docs, text_col, length, part, group))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("key"))
    told = look_up(rows, found, "key", total, how="left", bytes_of=F.size("covers") * 16, most=BROADCAST_COVERS)

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            done = [kept(t, [(c["first"], c["last"]) for c in covers or ()], length) for t, covers in zip(texts, b.column(2).to_pylist())]
            numbers = [pa.array([len(t) for t in texts], pa.int64()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([d[0] for d in done], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return told.select("doc_id", "text", "covers").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

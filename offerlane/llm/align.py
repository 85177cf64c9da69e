"""Alignment of two tokenizers' tokens over the same bytes, as relations.

No token of either side reaches over a place where a blank follows a character that is none, so a text is a sequence of words,
and every word's end is one of both sides' (where a vocabulary has such tokens, texts are taken whole, as one word each). A chunk
of texts is a list of its distinct words and, for each text, the words' numbers; only words are aligned, each once a chunk, and a
text's groups and links are those of its words in their order.

Each word's ids are dealt once by chunk; from there on no token leaves its partition. The tokens of both sides are rows (posexplode); a
window over each side adds their lengths up to the byte at which each ends. Ends of both sides are matched on (word, end):
as a full join of the sides would lose the partitioning, it is said as a grouping of the stacked sides, which keeps it. Where
both sides end is a cut; the number of cuts from the end on numbers the groups.

Each stretch between neighbouring ends lies in exactly one token of each side, and two tokens overlap in one stretch at most:
so the links of a word are its stretches, with the tokens that reach over them, and no range join is needed.

Links are counted over the corpus by pairs of ids, once a document, and looked up again by pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import checkpointed, chunks, look_up, shared_dir, ship, texts_of
from offerlane.llm.tokens import VOCABULARY, Merger, _is_latin, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Bytes of texts whose distinct words are a chunk, at least and at most; a longer text is a chunk of its own.
CHUNKS = (1 << 20, 8 << 20)
#: Bytes of text in a partition, about (its tokens are 40 to 60 times as large as rows), and partitions at most.
PART_BYTES, PARTS = 3 << 20, 20_000
#: Distinct words whose ids a Python worker keeps, and characters of a word that is kept.
KEPT, KEPT_LENGTH = 200_000, 48
#: Pairs of ids whose counts are broadcast (about 40 bytes each); more are looked up by a join that splits hot pairs.
BROADCAST_PAIRS = 500_000
_WORDS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+\Z").findall


def _bytes_of_piece(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


class LeftSide:
    """The ids that byte-level BPE gives texts; length says how many bytes each id has."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.merger.special, self.merger.cut = {}, None  # special strings are plain text
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)  # one character for each byte

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of words; unlike Merger.encode, no pre-token is kept, as nearly all words are one."""
        m = self.merger
        parts = [[t] if t.isascii() and t[:1] == " " and t[1:].isalpha() else (m.split_latin if _is_latin(t) else m.split)(t) for t in texts]
        flat, out, at = [p.encode() for own in parts for p in own], [], 0
        found = [ids for x in range(0, len(flat), 50_000) for ids in m.merge(flat[x : x + 50_000])]
        for own in parts:
            out.append(found[at] if len(own) == 1 else b"".join(found[at : at + len(own)]))
            at += len(own)
        return out


class RightSide:
    """The same for pieces, of texts that begin with a blank, which the model adds itself. A text that the model rewrites
    gets no ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [_bytes_of_piece(p) for p in pieces]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array(ids, "<u4").tobytes() if b"".join([self.bytes[i] for i in ids]) == t.encode() else b"" for t, ids in zip(texts, found)]


class Sides:
    """The ids of both sides. Neither side has a token across a place where a blank follows a character that is none (if a
    piece of the vocabulary does, texts are taken whole), so a text is the words between such places, and those have the
    same ids wherever they stand; a worker keeps the ids of short ones."""

    def __init__(self, left: str, right: str):
        self.left, self.right = LeftSide(left), RightSide(right)
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.again: set[str] = set()  # of those, the ones asked for since words were last forgotten

    def words(self, text: str) -> list[str]:
        return _WORDS(text) if self.right.apart else [text]

    def ids(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of distinct words on either side. Most words of a corpus come once: where there are too many to keep, those
        that came again are."""
        new = [w for w in words if w not in self.kept]
        found = dict(zip(new, zip(self.left(new), self.right(new))))
        out = [found[w] if w in found else self.kept[w] for w in words]
        self.again.update(set(words).difference(found))
        if len(self.kept) + len(new) > KEPT:
            self.kept = {w: self.kept[w] for w in self.again} if 2 * len(self.again) < KEPT else {}
            self.again = set()
        self.kept.update((w, x) for w, x in found.items() if len(w) <= KEPT_LENGTH)
        return out

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids on either side; of both none where a side has not the text's bytes."""
        words = [self.words(" " + t) if t else [] for t in texts]
        distinct, out = list(set().union(*words)), []
        get = dict(zip(distinct, self.ids(distinct))).__getitem__
        for t, own in zip(texts, words):
            a, b = (np.frombuffer(b"".join(x), "<u4") for x in zip(*map(get, own))) if own else (_NONE, _NONE)
            n = len(t.encode()) + 1
            out.append((a, b) if self.left.length[a].sum() == self.right.length[b].sum() == n else (_NONE, _NONE))
        return out


_NONE = np.empty(0, "<u4")


@cache
def sides(left: str, right: str) -> Sides:
    return Sides(vocabulary_path(left), vocabulary_path(right))


def _tokens(docs: DataFrame, id_col: str, text_col: str, left: str, right: str, kind: str) -> DataFrame:
    """(row, doc_id, n_left, ids): the left side's ids, then the right side's."""
    spans = {"short": (np.int16, pa.int16()), "int": (np.int32, pa.int32())}

    def run(batches):
        both, (to, arrow) = sides(left, right), spans[kind]
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in chunks(texts):
                found = both([t.decode("utf-8") for t in texts[i:j]])
                held = [x.astype(to) for pair in found for x in pair]
                ends = np.append(0, np.cumsum([len(a) + len(b) for a, b in found]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held), arrow))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([len(a) for a, _ in found], pa.int32()), lists], ["row", "doc_id", "n_left", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id long, n_left int, ids array<{kind}>")


def _dealt(docs: DataFrame, id_col: str, text_col: str, left: str, right: str, kind: str, limit: int) -> DataFrame:
    """(chunk, row, doc_id, words, n_left, ids): a row for each text, with its words' numbers in the chunk (none if a tokenizer
    rewrites a word of it), and one for each distinct word of a chunk: row is chunk + its number, and has its ids as in _tokens."""
    spans = {"short": (np.int16, pa.int16()), "int": (np.int32, pa.int32())}
    names = ["chunk", "row", "doc_id", "words", "n_left", "ids"]

    def lists(values, sizes, kind):
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))

    def run(batches):
        both, (to, arrow) = sides(left, right), spans[kind]
        number: dict[str, int] = {}
        rewritten: set[int] = set()
        chunk, held = None, 0
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in chunks(texts):
                size = sum(map(len, texts[i:j]))
                if chunk is None or held + size > limit:
                    # words are numbered through a partition, whose number is above the 33rd bit of its rows
                    chunk = batch.column(0)[0].as_py() >> 33 << 33 if chunk is None else chunk + len(number)
                    number, rewritten, held = {}, set(), 0
                held += size
                words = [both.words(" " + t.decode()) if t else [] for t in texts[i:j]]
                new, at = list(set().union(*words).difference(number)), len(number)
                number.update(zip(new, range(at, at + len(new))))
                found = both.ids(new)
                n_a, n_b = (np.array([len(x[k]) // 4 for x in found], np.int64) for k in (0, 1))
                whole = np.array([len(w.encode()) for w in new], np.int64)
                for k, (side, n) in enumerate(((both.left, n_a), (both.right, n_b))):
                    sums = np.append(0, np.cumsum(side.length[np.frombuffer(b"".join([x[k] for x in found]), "<u4")]))
                    ends = np.cumsum(n)
                    whole[sums[ends] - sums[ends - n] != whole] = -1
                rewritten.update((np.flatnonzero(whole < 0) + at).tolist())
                own = [list(map(number.__getitem__, w)) for w in words]
                if rewritten:
                    own = [x if rewritten.isdisjoint(x) else [] for x in own]
                told = lists(np.concatenate([np.array(x, np.int32) for x in own]), [len(x) for x in own], pa.int32())
                n = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), batch.column(0)[i:j], batch.column(1)[i:j], told, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(arrow))], names)
                good = np.flatnonzero(whole >= 0)
                if n := len(good):
                    ids = lists(np.frombuffer(b"".join([x for k in good.tolist() for x in found[k]]), "<u4").astype(to), (n_a + n_b)[good], arrow)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(chunk + at + good), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(n_a[good], pa.int32()), ids], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"chunk long, row long, doc_id long, words array<int>, n_left int, ids array<{kind}>")


def _held(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0


def _parts(docs: DataFrame, held: int) -> int:
    return int(min(PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, held // PART_BYTES + 1)))


def _id_lengths(left: str, right: str) -> tuple[np.ndarray, np.ndarray, str]:
    """How many bytes the ids of either side have, and the type that holds them all."""
    a, b = (x.length for x in (sides(left, right).left, sides(left, right).right))
    return a, b, "short" if max(len(a), len(b)) <= 1 << 16 else "int"


def _stretched(rows: DataFrame, key: str, beside: str, left: str, right: str) -> DataFrame:
    """rows(key, beside, n_left, ids), dealt by either column -> (key, beside, end, a, b, over_a, over_b, group)."""
    a, b, kind = _id_lengths(left, right)
    mask = 0xFFFF if kind == "short" else 0x7FFFFFFF
    tokens = rows.select(key, beside, "n_left", F.posexplode_outer("ids").alias("pos", "id"))
    tokens = tokens.select(key, beside, "pos", (F.col("pos") >= F.col("n_left")).alias("right"), F.col("id").cast("int").bitwiseAND(mask).alias("id"))
    lengths = F.split(F.lit(",".join(map(str, [*a.tolist(), *b.tolist()]))), ",").cast("array<int>")
    tokens = tokens.withColumn("length", F.get(lengths, F.col("id") + F.when(F.col("right"), len(a)).otherwise(0)))
    so_far = Window.partitionBy(key, "right", beside).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = tokens.withColumn("end", F.sum("length").over(so_far))
    own = lambda mine: F.max(F.when(mine, F.col("id")))
    matched = ended.groupBy(key, beside, "end").agg(own(~F.col("right")).alias("a"), own(F.col("right")).alias("b"))
    back = Window.partitionBy(key, beside).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    return matched.select(key, beside, "end", "a", "b", F.last("a", True).over(back).alias("over_a"), F.last("b", True).over(back).alias("over_b"), F.sum(cut).over(back).alias("group"))


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: str = VOCABULARY, right: str = PIECES) -> DataFrame:
    """(row, doc_id, end, a, b, over_a, over_b, group), a row for each byte offset at which a token of either side ends: the
    token of each side that ends there (or null), those that reach over the stretch up to there, and the group's number,
    counted from the text's end. A row without tokens has one line of nulls. row tells rows of docs apart."""
    ship(docs.sparkSession)
    rows = _tokens(docs, id_col, text_col, left, right, _id_lengths(left, right)[2])
    return _stretched(rows.repartition(_parts(docs, _held(docs, text_col)), "row"), "row", "doc_id", left, right)


def _by_chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: str = VOCABULARY, right: str = PIECES) -> tuple:
    """Of the same chunks, (chunk, word, end, ends, over), a line for each stretch of a word: whether a (2) and b (1) end there,
    and the ids over it as one number; and (chunk, row, doc_id, words), a line for each row of docs. Both grouped by chunk."""
    spark = docs.sparkSession
    ship(spark)
    held = _held(docs, text_col)
    parts, at = _parts(docs, held), f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    limit = min(max(CHUNKS[0], held // (2 * spark.sparkContext.defaultParallelism)), CHUNKS[1])
    _dealt(docs, id_col, text_col, left, right, _id_lengths(left, right)[2], limit).write.parquet(at)
    dealt = spark.read.parquet(at)
    words = dealt.where("n_left is not null").select("chunk", F.col("row").alias("word"), "n_left", "ids").repartition(parts, "chunk")
    ends = F.col("a").isNotNull().cast("int") * 2 + F.col("b").isNotNull().cast("int")
    over = F.shiftleft(F.col("over_a").cast("long"), 32) + F.col("over_b")
    cells = _stretched(words, "word", "chunk", left, right).select("chunk", "word", F.col("end").cast("int").alias("end"), ends.alias("ends"), over.alias("over"))
    texts = dealt.where("n_left is null").select("chunk", "row", "doc_id", "words").repartition(parts, "chunk")
    return cells.groupBy("chunk"), texts.groupBy("chunk")


class Aligned:
    """The words of a chunk: each one's groups, as `;a1,a2|b1;a3|b2,b3`, its links, and how many of all it has."""

    def __init__(self, chunk: int, cells: pa.Table):
        word, end, ends, over = (cells.column(c).to_numpy() for c in ("word", "end", "ends", "over"))
        word = word - chunk
        order = np.argsort((word << 32) | end)
        word, ends, self.over = word[order], ends[order], over[order]
        a, b = (ends & 2) > 0, (ends & 1) > 0
        self.at = np.searchsorted(word, np.arange((word[-1] if len(word) else -1) + 2))
        before_a, before_b, before_cut = (np.append(np.int32(0), np.cumsum(x, dtype=np.int32)) for x in (a, b, a & b))
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x[self.at]) for x in (before_a, before_b, before_cut, np.arange(len(word) + 1)))
        # a group's ids of the left side stand before those of the right side
        cuts = np.flatnonzero(a & b)
        in_a, in_b = np.flatnonzero(a), np.flatnonzero(b)
        group_a, group_b = before_cut[in_a], before_cut[in_b]
        marked = np.empty(len(in_a) + len(in_b), np.int64)
        marked[before_a[in_a] + np.append(0, before_b[cuts + 1])[group_a]] = (self.over[in_a] >> 32) * 4 + np.where(np.diff(group_a, prepend=-1) > 0, 0, 1)
        marked[before_b[in_b] + before_a[cuts + 1][group_b]] = (self.over[in_b] & 0xFFFFFFFF) * 4 + np.where(np.diff(group_b, prepend=-1) > 0, 2, 1)
        edges, self.groups = (before_a + before_b)[self.at], []
        for low in range(0, len(edges) - 1, 1 << 14):
            some = edges[low : low + (1 << 14) + 1]
            shown, cut = list(map(_marked, marked[some[0] : some[-1]].tolist())), (some - some[0]).tolist()
            self.groups += ["".join(shown[x:y]) for x, y in zip(cut, cut[1:])]

    def groups_of(self, words: np.ndarray) -> str:
        return "".join(map(self.groups.__getitem__, words.tolist()))[1:]

    def links_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct links of a text of these words, and how many it has of each."""
        n = self.n_links[words]
        ends = np.cumsum(n)
        links = np.sort(self.over[np.repeat(self.at[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        first = np.flatnonzero(np.diff(links, prepend=-1))
        return links[first], np.diff(np.append(first, len(links)))


@cache
def _marked(number: int) -> str:
    """An id with the sign before it."""
    return ";,|"[number % 4] + str(number // 4)


def _words_of(texts: pa.Table) -> list[np.ndarray]:
    """Each text's words, by number."""
    lists = texts.column("words").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[x:y] for x, y in zip(offsets, offsets[1:])]


def _aligned(cells: pa.Table, texts: pa.Table) -> Aligned:
    sides.cache_clear()  # a worker that gave words their ids before needs none of that now
    return Aligned(texts.column("chunk")[0].as_py(), cells)


def _lists(parts: list[list[np.ndarray]], names: list[str], types: list) -> pa.ListArray:
    """For each text a list of structs, from one array for each field."""
    flat = [np.concatenate(p) if p else np.empty(0, np.int64) for p in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(names)
    ends = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(f, t) for f, t in zip(flat, types)], names))


def alignment(docs: DataFrame, *args) -> DataFrame:
    """(doc_id, groups, links) of each row of docs: the groups of token ids, as `a1,a2|b1;a3|b2,b3`, and how many links each
    pair of ids has. Arguments are those of stretches."""

    def run(cells: pa.Table, texts: pa.Table) -> pa.Table:
        of, words = _aligned(cells, texts), _words_of(texts)
        links = _lists([[p >> 32, p & 0xFFFFFFFF, n] for p, n in map(of.links_of, words)], ["a", "b", "n"], [pa.int64()] * 3)
        return pa.table([texts.column("doc_id"), pa.array(map(of.groups_of, words), pa.string()), links], ["doc_id", "groups", "links"])

    cells, texts = _by_chunk(docs, *args)
    return cells.cogroup(texts).applyInArrow(run, "doc_id long, groups string, links array<struct<a:long,b:long,n:long>>")


_DIGEST = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,n:int>>"


def _digests(docs: DataFrame, *args) -> DataFrame:
    names = [c.split()[0] for c in _DIGEST.split(", ")]

    def run(cells: pa.Table, texts: pa.Table) -> pa.Table:
        of, words = _aligned(cells, texts), _words_of(texts)
        numbers = [pa.array([int(n[w].sum()) for w in words], pa.int64()) for n in (of.n_a, of.n_b, of.n_groups, of.n_links)]
        shas = pa.array([hashlib.sha256(of.groups_of(w).encode()).hexdigest() if len(w) else "" for w in words], pa.string())
        pairs = _lists([list(of.links_of(w)) for w in words], ["pair", "n"], [pa.int64(), pa.int32()])
        return pa.table([texts.column("row"), texts.column("doc_id"), *numbers, shas, pairs], names)

    cells, texts = _by_chunk(docs, *args)
    return cells.cogroup(texts).applyInArrow(run, _DIGEST)


def pair_counts(links: DataFrame) -> DataFrame:
    """links(a, b), a line for each document and pair -> (a, b, docs, best): in how many documents the pair is linked, and
    whether that is the most of all pairs of its a (ties too)."""
    counted = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _halves(pair: str) -> tuple[Column, Column]:
    return F.shiftright(pair, 32).alias("a"), F.col(pair).bitwiseAND(0xFFFFFFFF).alias("b")


def link_scores(docs: DataFrame, *args) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs, repeated rows
    too. Texts that are null, empty or rewritten by a tokenizer have no tokens: zeros and ''. Texts are whole: the longest
    one takes the memory of its words' numbers and tokens as arrays. Empty docs give an empty table; other columns aren't read."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    _digests(docs, *args).write.parquet(at)
    told = spark.read.parquet(at)
    each = told.select("row", F.explode("pairs").alias("x")).select("row", "x.pair", F.col("x.n").alias("times"))
    counts = checkpointed(pair_counts(each.select(*_halves("pair"))).select((F.shiftleft("a", 32) + F.col("b")).alias("pair"), F.col("docs").alias("n"), "best"))
    held = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if held["k"] <= BROADCAST_PAIRS:
        scored = each.join(F.broadcast(counts), "pair")
    else:
        scored = look_up(each, counts, "pair", held["n"])
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return told.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

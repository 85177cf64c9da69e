"""Byte-level BPE as rank-synchronous array merging.

Texts are split into pre-tokens. The distinct pre-tokens of a batch lie in one ragged array of symbols; in every round
each sequence merges all places of its lowest-ranked pair at once, until no sequence has a pair of the vocabulary left.
The symbols that survive are the tokens. Long sequences (runs without a blank) take their ranks in the same order, but a
round touches only the places that have the rank.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import chunks, ship, texts_of

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens whose ids a Python worker keeps between batches; beyond, it forgets all and goes on.
KEPT = 200_000
#: Bytes of a pre-token beyond which it is merged rank by rank, as a round over all its symbols for each is slow.
LONG = 128
_SLOTS = 1 << 19
#: Fixed value: how the vocabulary's byte-level pre-tokenizer splits.
_SPLIT = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# the same over U+0000 to U+00FF, with those classes written out, for the faster engine
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT_LATIN = f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> list[str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS.bit_length() + 1)).view(np.int64)


class Merger:
    """The tokens of pre-tokens, by arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in _byte_characters()], np.int64)
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.made, self.none = np.append(made, 0), len(made)
        self._index(pairs)
        self.split, self.split_latin = regex.compile(_SPLIT).findall, re.compile(_SPLIT_LATIN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    def _index(self, pairs: np.ndarray) -> None:
        """An open-addressing table of pairs and their ranks: a pair lies at its slot or at one of the next few."""
        self.table, self.rank_at, taken = np.full(_SLOTS + 64, -1, np.int64), np.full(_SLOTS + 64, len(pairs), np.int64), set()
        self.reach = 1
        for rank, (pair, slot) in enumerate(zip(pairs.tolist(), _slot(pairs).tolist())):
            at = slot
            while at in taken:
                at += 1
            taken.add(at)
            self.table[at], self.rank_at[at] = pair, rank
            self.reach = max(self.reach, at - slot + 1)

    def _pair_ranks(self, pair: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a rank beyond all."""
        at = _slot(pair)
        held = self.table[at]
        rank = np.where(held == pair, self.rank_at[at], self.none)
        open_ = np.flatnonzero((held != pair) & (held >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            there = at[open_] + step
            held = self.table[there]
            same = held == pair[open_]
            rank[open_[same]] = self.rank_at[there[same]]
            open_ = open_[~same & (held >= 0)]
        return rank

    def _ranks(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol; a rank beyond all for none and for each sequence's last."""
        rank = np.append(self._pair_ranks((symbols[:-1] << 32) | symbols[1:]), self.none)
        rank[ends - 1] = self.none
        return rank

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (none is empty), as little-endian unsigned 32-bit numbers."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if not long:
            return self._merge_short(tokens)
        short = [i for i, t in enumerate(tokens) if len(t) <= LONG]
        out: list = [b""] * len(tokens)
        for some, found in ((short, self._merge_short([tokens[i] for i in short]) if short else []), (long, self._merge_long([tokens[i] for i in long]))):
            for i, ids in zip(some, found):
                out[i] = ids
        return out

    def _merge_long(self, tokens: list[bytes]) -> list[bytes]:
        """The same for long pre-tokens. The lowest rank of all sequences is the lowest of each that has it, so ranks are
        taken one after the other, and only the places that have the rank, and their neighbours, are touched."""
        ends = np.cumsum([len(t) for t in tokens])
        symbols, n, none = self.first[np.frombuffer(b"".join(tokens), np.uint8)], int(ends[-1]), self.none
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        after[ends - 1] = n  # n stands for no place
        before[np.append(0, ends[:-1])] = n
        rank = np.append(self._ranks(symbols, ends), none)
        held: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < none]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            mine = rank[places]
            cuts = np.flatnonzero(mine[1:] != mine[:-1]) + 1
            for r, some in zip(mine[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if r not in held:
                    held[r] = []
                    heapq.heappush(queue, r)
                held[r].append(some)

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            some = held.pop(r)
            at = np.unique(np.concatenate(some)) if len(some) > 1 else some[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of places that follow each other (a pair of equal symbols), each run's first, third, ... are merged
            follows = np.append(False, after[at[:-1]] == at[1:])
            if follows.any():
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbols[at], rank[gone], after[at] = self.made[r], none, then
            inside = then < n
            before[then[inside]] = at[inside]
            ahead = before[at]
            near = np.unique(np.concatenate((at, ahead[ahead < n])))
            rank[near] = none
            near = near[after[near] < n]
            rank[near] = self._pair_ranks((symbols[near] << 32) | symbols[after[near]])
            put(near)
            symbols[gone] = -1
        kept = symbols >= 0
        sizes = np.add.reduceat(kept, np.append(0, ends[:-1]), dtype=np.int64)
        ids, edges = symbols[kept].astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [ids[x:y] for x, y in zip([0, *edges], edges)]

    def _merge_short(self, tokens: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in tokens], np.int64)
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        out: list = [None] * len(tokens)
        own, none = np.arange(len(tokens)), self.none
        while len(own):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = self._ranks(symbols, ends)
            least = np.minimum.reduceat(rank, starts)
            if (over := least == none).any():
                mine = np.repeat(over, sizes)
                ids, edge = symbols[mine].astype("<u4").tobytes(), (4 * np.cumsum(sizes[over])).tolist()
                for i, a, b in zip(own[over].tolist(), [0, *edge], edge):
                    out[i] = ids[a:b]
                symbols, rank, own, sizes, least = symbols[~mine], rank[~mine], own[~over], sizes[~over], least[~over]
                if not len(own):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hit = rank == np.repeat(least, sizes)
            # of places that follow each other (a pair of equal symbols), each run's first, third, ... are merged
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run) % 2 == 0
            symbols = np.where(hit, self.made[rank], symbols)
            gone = np.append(False, hit[:-1])
            sizes = sizes - np.add.reduceat(gone, starts, dtype=np.int64)
            symbols = symbols[~gone]
        return out

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and those (True)."""
        return [(p, i % 2 == 1) for i, p in enumerate(self.cut.split(text)) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers. Special strings in a text are their own ids."""
        parts = []
        for t in texts:
            split = self.split_latin if _is_latin(t) else self.split
            if not any(s in t for s in self.special):
                parts.append(split(t))
                continue
            own: list[str] = []
            for p, special in self.pieces(t):
                own += [("\0" + p)] if special else split(p)
            parts.append(own)
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = list(set().union(*parts).difference(self.kept))
        plain = [w for w in new if not (w[0] == "\0" and w[1:] in self.special)]
        for w in new:
            if w[0] == "\0" and w[1:] in self.special:
                self.kept[w] = np.array([self.special[w[1:]]], "<u4").tobytes()
        for at in range(0, len(plain), 50_000):
            some = plain[at : at + 50_000]
            self.kept.update(zip(some, self.merge([w.encode() for w in some])))
        get = self.kept.__getitem__
        return [b"".join(map(get, own)) for own in parts]


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def encoded(texts: list[bytes], path: str):
    """Ids of each text, in order, with bounded batches."""
    m = merger(path)
    for a, b in chunks(texts):
        yield from m.encode([t.decode("utf-8") for t in texts[a:b]])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs, repeated rows too. Null counts as empty: no
    bytes, no tokens. Texts are whole; other columns of docs aren't read."""
    ship(docs.sparkSession)

    def run(batches):
        path = vocabulary_path(name)
        for b in batches:
            texts = texts_of(b.column(1))
            n = np.array([len(ids) // 4 for ids in encoded(texts, path)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)

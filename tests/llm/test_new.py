"""Alignment, importance resampling and removal of repeats against brute force, on whole small tables and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm import ODD, SCHEMA, SMALL, tokenizer

from offerlane.llm import align, queries, resample, suffixes
from offerlane.llm.common import table


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", {"k": 1}) for r in ODD] + [(9, "  two  blanks ▁ here \0 <s> ", "en", "s", 1, 1, 1, "k", "y", None), (10, "  two  blanks here <0x41> ", "en", "s", 1, 1, 1, "k", "y", None)]
    return spark.createDataFrame(rows, SCHEMA + ", n string, hot map<string,int>")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# 11


def slow_alignment(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    byte = {(chr(b) if b in shown else chr(next(hidden))): b for b in range(256)}

    def left_bytes(i):
        return bytes(byte[c] for c in left.id_to_token(i))

    def right_bytes(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    told, counts = [], collections.Counter()
    for i, text in docs:
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        x, y = [left_bytes(t) for t in a], [right_bytes(t) for t in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            told.append((i, [], [], "", [], 0))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (x, y)]
        groups, links, at = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, es) if at < e <= cut) for ids, es in zip((a, b), ends)) if len(a) < 2000 else "")
            at = cut
        for t, e, s in zip(a, ends[0], x):
            first = np.searchsorted(ends[1], e - len(s), "right")
            for k in range(first, len(b)):
                links.append((t, b[k]))
                if ends[1][k] >= e:
                    break
        told.append((i, a, b, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 2000 else None, links, len(groups)))
        counts.update(set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(i, len(a), len(b), n, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha) for i, a, b, sha, links, n in told]


def same_alignment(got, want):
    got, want = in_order(got), in_order(want)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:7])), sorted(want, key=lambda r: repr(r[:7]))):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


@pytest.mark.parametrize("broadcast", [500_000, 10])
def test_alignment_whole_table(spark, broadcast, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", broadcast)
    got = queries.op11_token_alignment(spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same_alignment(got.collect(), slow_alignment(rows_of(table(spark, SMALL, "documents"))))


def test_alignment_odd_rows(odd, none):
    got = align.link_scores(odd).collect()
    same_alignment(got, slow_alignment(rows_of(odd)))
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert by[3] == by[4] == by[9] == (0, 0, 0, 0, 0, 0, "")
    assert by[10][0] > 0
    assert align.link_scores(none).count() == 0


def test_alignment_says_groups_and_links(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align.alignment(docs).collect()}
    groups = [g.split("|") for g in got[1]["groups"].split(";")]
    both = align.sides(align.VOCABULARY, align.PIECES)
    for a, b in groups:
        assert both.left.length[[int(x) for x in a.split(",")]].sum() == both.right.length[[int(x) for x in b.split(",")]].sum()
    assert sum(x["n"] for x in got[1]["links"]) >= len(groups)
    assert got[2]["groups"] == "" and got[2]["links"] == []


def test_words_have_the_same_ids_anywhere():
    both = align.sides(align.VOCABULARY, align.PIECES)
    assert both.right.apart
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "日", "the", "1", "\t", "\x1c", "\xa0", "'s", "!"]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    left = tokenizer()
    for t, w, x, (a, b) in zip(texts, both.right.model.encode(texts), left.encode_batch([" " + t for t in texts], add_special_tokens=False), both(texts)):
        assert "".join(both.words(" " + t)) == " " + t
        whole = b"".join(both.right.bytes[i] for i in w) == (" " + t).encode()
        assert (x.ids, w) == (a.tolist(), b.tolist()) if whole else len(a) == len(b) == 0


# 12


def slow_resampled(docs, target, longest=1, buckets=10_000, seed=2024, least=20, per_cent=10):
    def features(text):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    own, want = [features(t) for _, t in docs], [features(t) for _, t in target]
    s, t = (collections.Counter(b for _, x in y for b in x) for y in (own, want))
    gain = {b: math.floor(1000 * math.log(float((t[b] + 1) * (s.total() + buckets)) / float((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for (i, _), (n, x) in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x)
        rows.append([i, n, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * per_cent // 100], 1):
        r[5] = k
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("longest,ranges", [(1, 4096), (3, 3)])
def test_resampled_whole_table(spark, longest, ranges, monkeypatch):
    monkeypatch.setattr(resample, "RANGES", ranges)
    docs, target = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    got = resample.resampled(docs, target, longest=longest)
    assert in_order(got.collect()) == in_order(slow_resampled(rows_of(docs), [(0, r["text"]) for r in target.collect()], longest))


def test_resampled_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("word epsilon",), (None,), ("",)], "text string")
    for items in (target, target.where("false")):
        got = resample.resampled(odd, items, longest=2, least_words=1, per_cent=60).collect()
        want = slow_resampled(rows_of(odd), [(0, r["text"]) for r in items.collect()], 2, least=1, per_cent=60)
        assert in_order(r[:5] for r in got) == in_order(r[:5] for r in want)
        assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[5] for r in want if r[5])
        assert {r["score"] for r in got if r["rank"]} == {r[4] for r in want if r[5]}
    assert resample.resampled(none, target).count() == 0


def test_ties_and_copies_are_ranked_one_by_one(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 50 + [(i, "a b c") for i in range(50)], "doc_id long, text string")
    got = resample.resampled(docs, docs, least_words=1, per_cent=70).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 71))
    scores = [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True) and min(scores) >= max(r["score"] for r in got if not r["rank"])


def test_suffix_array_of_words():
    rng = np.random.default_rng(4)
    sizes = [5, 0, 1, 30, 4]
    ids = rng.integers(0, 3, sum(sizes))
    ends = np.repeat(np.cumsum(sizes), sizes)
    for depth in (1, 2, 4):
        order, common = resample.suffix_array(ids, ends - np.arange(len(ids)), depth)
        cut = [tuple(ids[i : min(i + depth, e)]) for i, e in enumerate(ends)]
        assert [cut[i] for i in order] == sorted(cut)
        for a, b, h in zip(order, order[1:], common[1:]):
            assert h == next((k for k, (x, y) in enumerate(zip(cut[a], cut[b])) if x != y), min(len(cut[a]), len(cut[b])))


# 13


def slow_kept(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone[1:-1]].tobytes()))
    return out


def same_kept(docs, length, **more):
    got = suffixes.without_repeats(docs, length=length, **more).collect()
    rows = rows_of(docs)
    want = [(i, *k) for (i, _), k in zip(rows, slow_kept([(t or "").encode() for _, t in rows], length))]
    assert in_order((*r[:4], bytes(r[4])) for r in got) == in_order(want)
    return want


def test_repeats_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    rows = rows_of(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_dedup(spark, SMALL).collect()}
    want = {i: (*k[:3], hashlib.sha256(k[3]).hexdigest()) for (i, _), k in zip(rows, slow_kept([(t or "").encode() for _, t in rows], 200))}
    assert got == want and sum(w[1] for w in want.values()) > 0


def mosaic(seed, n):
    """Texts of pieces of a few long strings, so that strings repeat with all kinds of ends."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    return [(i, "".join(rng.choice(base)[rng.randrange(20) : rng.randrange(30, 60)] for _ in range(rng.randrange(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("group,chunk,hot", [(30_000, 1 << 20, False), (2, 1 << 20, False), (30_000, 100, False), (30_000, 1 << 20, True)])
def test_repeats_close_to_each_other(spark, group, chunk, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    if hot:  # every part that stands often in the sample is hot, and all rows are sampled
        monkeypatch.setattr(suffixes, "SAMPLE", 1)
    docs = spark.createDataFrame(mosaic(5, 40) + [(100, "é" * 150), (101, "x" * 50), (102, "x" * 50)], "doc_id long, text string")
    for length in (24, 33):
        assert sum(w[2] for w in same_kept(docs, length, group=group)) > 0


def test_repeats_odd_rows(odd, none):
    want = same_kept(odd, 30)
    assert any(w[2] for w in want)
    assert suffixes.without_repeats(none).count() == 0


def test_losers_merge_front_coded_runs():
    rng = random.Random(3)
    for k in (1, 2, 5, 8):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 70))).encode() for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        got = list(suffixes.merged([suffixes.front_coded(r) if r else ([], []) for r in runs]))
        strings = [s for _, _, s, _ in got]
        assert strings == sorted(s for r in runs for s in r)
        assert all(runs[r][i] == s for r, i, s, _ in got)
        assert [h for *_, h in got][1:] == [suffixes.common_bytes(a, b) for a, b in zip(strings, strings[1:])]

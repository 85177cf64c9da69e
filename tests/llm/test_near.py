"""The pipeline's dedup stages against brute force over shingle sets, and on rows without or with repeated ids."""

import random

import corpus_pipeline
import numpy as np
import pytest
from offerlane.llm import near
from offerlane.llm.common import table


def sets_of(texts, words=5):
    split = {i: t.encode().lower().split() for i, t in texts.items()}
    return {i: {b" ".join(ws[j : j + words]) for j in range(max(1, len(ws) - words + 1))} for i, ws in split.items()}


def slow_kept(texts):
    """The smallest id of each component of all pairs with a Jaccard similarity of 0.8."""
    s, root = sets_of(texts), {i: i for i in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 4 * max(len(s[a]), len(s[b])) <= 5 * min(len(s[a]), len(s[b])) and 5 * (both := len(s[a] & s[b])) >= 4 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return set(root.values())


def test_near_stage_finds_all_pairs_of_the_similarity(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").dropDuplicates(["text"]).where("text is not null and doc_id is not null").cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = slow_kept(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, d).collect()} == want and len(texts) - len(want) >= 5


def test_near_stage_links_a_large_group_and_rows_without_id(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(60) for k in [rng.randrange(200)]]
    rows += [(100 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    half = base[:100] + [f"z{i}" for i in range(100)]
    rows += [(200, " ".join(half)), (None, "a text of its own without id here"), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == [0, *range(100, 120), 200]
    assert sorted((r[1] or "").strip() for r in got if r[0] is None) == ["", "a text of its own without id here"]


@pytest.mark.parametrize("part", [192, 7])
def test_near_stage_compares_what_central_texts_do_not_reach(spark, part, monkeypatch):
    """Groups under the same keys, too far from each other and from the keys' central texts."""
    monkeypatch.setattr(near, "PART", part)
    monkeypatch.setattr(near, "FEW", 3)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(240)], []
    for centre in range(8):
        middle = [w if rng.random() > 0.03 else word() for w in base]
        for _ in range(9):
            rows.append([w if rng.random() > 0.012 else word() for w in middle])
    texts = {i: " ".join(ws[: rng.randrange(200, 241)]) for i, ws in enumerate(rows)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = slow_kept(texts)
    assert {r["doc_id"] for r in near.without_near_copies(docs).collect()} == want and 1 < len(want) < len(texts)
    # all under two keys, each alone but for two
    sets = {i: near.shingle_set(t.encode(), 5) for i, t in texts.items()}
    root = {i: max(i, 1) for i in texts}
    own = spark.createDataFrame([(k, len(texts), i, root[i], len(sets[i]), i % 3 > 0) for k in (4, 5) for i in texts], "key long, n long, node long, root long, size long, stray boolean")
    nodes = docs.select(near.text_sha("text").alias("sha"), docs.doc_id.alias("node"))
    got = {tuple(r) for r in near._stray_links(own.withColumn("shared", own.size), near.Texts(docs, "text", nodes), 5).collect()}
    assert got == {(a, b) for a in texts for b in texts if a < b and root[a] != root[b] and (a % 3 or b % 3) and near.similar(sets[a], sets[b])} and len(got) > 20


def test_keys_that_share_texts_are_dealt_as_one_where_that_is_less(spark, monkeypatch):
    monkeypatch.setattr(near, "PART", 4)
    under = {k: range(k, k + 20) for k in range(10)} | {k: range(100 * k, 100 * k + 9) for k in (20, 21)}
    under |= {30 + k: range(4000 + 8 * k, 4009 + 8 * k) for k in range(9)}  # a chain
    rows = [(k, len(nodes), n, n % 7, 50 + n, 40, n == k) for k, nodes in under.items() for n in nodes]
    strays = spark.createDataFrame(rows, "key long, n long, node long, root long, size long, shared long, stray boolean")
    got = near._joined_keys(strays)
    assert got.columns == strays.columns
    got = [tuple(r) for r in got.collect()]
    as_one = [r for r in got if r[2] < 100]
    assert sorted(r[1:] for r in as_one) == [(29, n, n % 7, 50 + n, 40, n < 10) for n in range(29)] and len({r[0] for r in as_one}) == 1
    assert sorted(r for r in got if r[2] >= 100) == sorted(r for r in rows if r[2] >= 100)


def test_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    for step in (512, 1):
        near._STEP, kept = step, near._STEP
        got = near._common(sets)
        near._STEP = kept
        assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_dedup_stages_keep_one_row_of_each_group(spark):
    rows = [(None, "without id, alone"), (None, "without id, twice"), (None, "without id, twice"), (None, None), (None, "")]
    rows += [(1, "a repeated row"), (1, "a repeated row"), (2, "one id and two texts"), (2, "a copy of three"), (1, "a copy of three"), (3, "a copy of three")]
    rows += [(None, "a copy with an id elsewhere"), (9, "a copy with an id elsewhere"), (4, "a b"), (4, " ab"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, "without id, alone"), (None, "without id, twice"), (None, ""), (1, "a repeated row"), (2, "one id and two texts"), (1, "a copy of three"), (9, "a copy with an id elsewhere"), (4, "ab")}
    for stage in (corpus_pipeline.exact_stage, lambda s, d, at: corpus_pipeline.near_stage(s, corpus_pipeline.exact_stage(s, d, at), at)):
        got = [(r[0], (r[1] or "").replace("a b", "ab").strip()) for r in stage(spark, docs, "").collect()]
        assert len(got) == len(want) and set(got) == want

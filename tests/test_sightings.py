"""Codes' words and pairs, a market as a source, numbering by ranges, cached answers."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from offerlane.operators import cooccurrence, naming, windows
from offerlane.sources import connector


def surroundings(texts, reach=5):
    found = set()
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, x in enumerate(w):
            if len(x) >= 3 and re.search("[0-9]", x):
                found.add((x, (*w[max(i - reach, 0) : i], *w[i + 1 : i + 1 + reach])))
    return found


def test_code_words_and_pairs(spark):
    rng = random.Random(3)
    words = ["tank", "cover", "left", "seal", "ring", "für", "a", "Öldeckel", "x9"]
    texts = [" ".join(rng.choice([*words, "7391x", "555"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", "!?", "555", "555 7391x", texts[0], texts[0], "tank " * 3000 + "555"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    contexts = cooccurrence.code_contexts(df, "text")
    want = surroundings(texts)
    assert {(r["code"], tuple(r["words"])) for r in contexts.collect()} == want
    named = {c: [w for w in set(c[1]) if re.fullmatch(r"[^\W\d_]{4,}", w)] for c in want}
    n = Counter((c[0], w) for c, ws in named.items() for w in ws)
    assert {(r["code"], r["word"]): r["n"] for r in cooccurrence.code_words(contexts, least=30).collect()} == {k: v for k, v in n.items() if v >= 30}
    pairs = Counter((c[0], a, b) for c, ws in named.items() for a, b in itertools.combinations(sorted(w for w in ws if n[c[0], w] >= 30), 2))
    got = {(r["code"], r["a"], r["b"]): r["n"] for r in cooccurrence.code_pairs(contexts, least=30, least_pairs=5).collect()}
    assert got == {k: v for k, v in pairs.items() if v >= 5} and got
    assert cooccurrence.code_pairs(cooccurrence.code_contexts(df.where("false"), "text")).count() == 0


@pytest.fixture(scope="module")
def catalogue(tmp_path_factory):
    at = tmp_path_factory.mktemp("catalogue")
    rows = [("m1", 1, "red ring", 10.0), ("m1", 2, "blue ring", 99.995), ("m2", 3, "red bolt", 20.0), ("m2", 4, None, 30.0), (None, 5, "ring", 15.0), ("m3", 6, "ring", None)]
    for i in (0, 3):
        cols = list(zip(*rows[i : i + 3]))
        pq.write_table(pa.table({"p_brand": pa.array(cols[0], pa.string()), "p_partkey": pa.array(cols[1], pa.int64()), "p_name": pa.array(cols[2], pa.string()), "p_retailprice": pa.array(cols[3], pa.float64())}), at / f"{i}.parquet", row_group_size=1)
    return str(at)


ASKED = connector.Asked
CASES = [
    (ASKED(), {1, 2, 3, 4, 5, 6}), (ASKED(least=1500), {2, 3, 4, 5}), (ASKED(least=1000, most=1000), {1}), (ASKED(least=1500, most=2000), {3, 5}), (ASKED(most=10000, words="blue"), {2}), (ASKED(least=10000), {2}),
    (ASKED(("m1",)), {1, 2}), (ASKED(("m1", "m3")), {1, 2, 6}), (ASKED(()), set()), (ASKED(words="ring"), {1, 2, 5, 6}), (ASKED(words=""), {1, 2, 3, 5, 6}), (ASKED(("m1",), 1, 2000, "ring"), {1}),
]


@pytest.mark.parametrize("able", [connector.ABLE, ("price",), ()])
def test_market_filters_give_the_same_rows_whoever_applies_them(spark, catalogue, able):
    for asked, want in CASES:
        rows = connector.market_offers(spark, catalogue, asked, able)
        assert {r["offer"] for r in rows.collect()} == want, asked
    assert rows.rdd.getNumPartitions() == 2


def test_questions_to_one_market_do_not_mix(spark, catalogue):
    one, all_ = connector.market_offers(spark, catalogue, ASKED(("m1",))), connector.market_offers(spark, catalogue)
    assert one.count() == 2 and all_.count() == 6 and one.union(all_).count() == 8 and all_.where("cents > 1500").count() == 3 and all_.count() == 6


def test_asked_filters_leave_the_plan_and_refused_ones_stay(spark, catalogue):
    filters = lambda able: re.findall(r"Filter \(.*", connector.market_offers(spark, catalogue, ASKED(("m1",), least=1500), able)._jdf.queryExecution().executedPlan().toString())
    assert filters(connector.ABLE) == []
    (kept,) = filters(("price",))
    assert "m1" in kept and "1500" not in kept
    with pytest.raises(ValueError, match="no such filter"):
        connector.market_offers(spark, catalogue, able=("colour",))


def test_large_files_are_dealt_by_row_groups(spark, catalogue, monkeypatch):
    monkeypatch.setattr(connector, "SPLIT_BYTES", 0)
    rows = connector.market_offers(spark, catalogue, ASKED(least=1500))
    assert rows.rdd.getNumPartitions() == 6 and {r["offer"] for r in rows.collect()} == {2, 3, 4, 5}


def test_numbered_by_ranges(spark):
    rng = random.Random(1)
    rows = [(k, i) for i in rng.sample(range(-500, 500), 300) for k in [rng.choice(["a", "a", "a", "b", None])]]
    want = {(k, i): sum(1 for q, j in rows if q == k and j < i) for k, i in rows}
    got = windows.numbered(spark.createDataFrame(rows, "k string, i long"), "k", "i", "place", width=16)
    assert {(r["k"], r["i"]): r["place"] for r in got.collect()} == want


def test_longest_names_by_automaton_and_by_join(spark):
    rng = random.Random(9)
    letters = ["aa", "b", "c", "dé", "7"]
    names = {" ".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 6]))) for _ in range(60)} - {"b", "c"}
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "aa", "-- B,c;DÉ --", "aab caa", "aa 7 " * 4000]
    want = set()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        spans = {(i, i + n) for i in range(len(w)) for n in (1, 2, 3, 4, 6) if i + n <= len(w) and " ".join(w[i : i + n]) in names}
        want |= {(k, " ".join(w[i:j]), i, j - i) for i, j in spans if not any(p <= i and j <= q and (p, q) != (i, j) for p in range(max(i - 6, 0), i + 1) for q in range(j, j + 7) if (p, q) in spans)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("..",), *[(n.upper(),) for n in list(names)[:5]]], "n string")
    for bound in (1 << 20, 0):
        assert {tuple(r) for r in naming.longest_names(df, "id", "text", known, "n", inline_chars=bound).collect()} == want
    assert naming.longest_names(df, "id", "text", known.where("false"), "n").count() == 0


def test_ten_thousand_names(spark):
    names = spark.range(10000).selectExpr("concat('model ', id) AS n")
    texts = spark.createDataFrame([(1, "a model 77 and model 9999x, model 10000, MODEL 9999"), (2, "model")], "id long, text string")
    for bound in (naming.INLINE_CHARS, 0):
        assert {tuple(r) for r in naming.longest_names(texts, "id", "text", names, "n", inline_chars=bound).collect()} == {(1, "model 77", 1, 2), (1, "model 9999", 8, 2)}

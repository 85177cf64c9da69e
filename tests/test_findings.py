"""Steps whose rows, passes or memory grew faster than their input."""

import numpy as np
import pyarrow as pa
import pytest

from offerlane.functions import terms
from offerlane.operators import folding, joins, scoring
from offerlane.plans.catalogue import QUERIES
from offerlane.sources import shared

DIR = "/root/testdata/sf0.001"


def times_read(df, column):
    """How often a query's plan reads the table that has a column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(f"{column}#" in leaves.apply(i).toString() for i in range(leaves.size()))


def test_nearest_number_is_nearest_of_all_pairs(spark):
    left = spark.createDataFrame([("a", i, kw) for i, kw in enumerate([0, 5, 7, 7, 8, 30, None])] + [("b", 10, 4), ("c", 11, 1), ("d", 12, 3), (None, 13, 3)], "k string, id int, kw int")
    right = spark.createDataFrame([("a", 3, 6, 1.0), ("a", 1, 8, 2.0), ("a", 2, 8, 3.0), ("a", 9, 20, 4.0), ("a", 0, None, 5.0), ("b", 5, 4, 6.0), ("d", 4, None, 7.0)], "k string, model int, at int, price double")
    got = {(r["id"], r["model"], r["price"], r["distance"]) for r in joins.nearest_number(left, right, "k", "kw", "at", ["model", "price"]).collect()}
    assert got == {(0, 3, 1.0, 6), (1, 3, 1.0, 1), (2, 1, 2.0, 1), (3, 1, 2.0, 1), (4, 1, 2.0, 0), (5, 9, 4.0, 10), (6, 0, 5.0, None), (10, 5, 6.0, 0), (12, 4, 7.0, None)}


@pytest.mark.parametrize("name, times", [("replaced_source", 1), ("locale_key_anti", 1), ("narrow_results", 2)])
def test_offers_are_read_no_more_often_than_needed(spark, name, times):
    assert times_read(QUERIES[name](spark, DIR), "l_orderkey") == times


def test_nodes_that_can_meet_none_of_their_title_are_not_joined(spark):
    rows = [("a", "one", "EUR", 1, 5, None), ("b", "one", "EUR", 2, 5, None), ("c", "one", "USD", 2, 6, None), ("d", "two", "EUR", 3, 5, None), ("e", "two", "EUR", 3, 6, None)]
    rows += [("f", "six", "EUR", 1, 5, "x"), ("g", "six", "EUR", 2, 5, "x"), ("h", "ten", "EUR", 1, 5, None), ("i", "ten", "USD", 1, 5, None), ("j", "few", "EUR", 1, None, None), ("k", "few", "USD", 1, 7, None), ("l", "lot", None, None, None, None)]
    df = spark.createDataFrame(rows, "node string, key string, currency string, price_cents long, place int, family string")
    assert sorted(r["node"] for r in folding._may_meet(df).collect()) == list("defghijk")


def test_prints_are_counted_in_pieces(spark, monkeypatch):
    rows = [(i, [(i * 7919 + j * 104729) % 1021 for j in range(i % 5)] or None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, h array<long>").coalesce(1)
    whole = sorted(map(tuple, joins.majority_print(df, "id", "h").collect()))
    monkeypatch.setattr(joins, "PRINT_HASHES", 3)
    assert sorted(map(tuple, joins.majority_print(df, "id", "h").collect())) == whole and len(whole) == 32


def test_texts_are_normalised_alike_whatever_words_are_known(monkeypatch):
    text = "ein i phone mit 2,5 giga, 64gigabytes rtx4070ti 5++ +a 3.5+ i pad größer été"
    want = "ein iphone mit 2p5 gb 64 gb rtx4070ti 5 plus a 3 5 plus ipad groesser ete"
    assert terms._normalised(text, {}) == want
    monkeypatch.setattr(terms, "KNOWN_WORDS", 1)
    known = {}
    assert terms._normalised(text, known) == want and len(known) == 1


def test_nearest_vectors_are_told_in_pieces_without_python_objects(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([[1], [2, 3]]), pa.array([[[0.0, 1.0]], [[2.0, 3.0], [4.0, 5.0]]])], ["ids", "vectors"])
    assert scoring._side(batch, 0, 1).tolist() == [2, 3] and scoring._side(batch, 1, 1).tolist() == [[2.0, 3.0], [4.0, 5.0]]
    assert not scoring._side(batch, 1, 1).flags.owndata
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.random.default_rng(3).normal(size=(50, 6)))], "id long, v array<double>, label int")
    whole = sorted(map(tuple, scoring.nearest(df, df, "id", "v", 2, by="label").collect()))
    monkeypatch.setattr(scoring, "SIMS", 60)
    assert sorted(map(tuple, scoring.nearest(df, df, "id", "v", 2, by="label").collect())) == whole and len(whole) == 300


def test_only_offers_that_may_have_pairs_are_sent_again(spark, monkeypatch):
    names = "id string, title string, platform string, family string, place string, currency string, price_cents long, first_year int, mileage_km long, power_kw int"
    rows = [("a", "one long title", "m", None, "p", "EUR", 1), ("b", "one long title", "m", None, "p", "EUR", 2), ("c", "one long title", "m", None, "q", "EUR", 1), ("c2", "One long title", "m", None, "q", "EUR", 1)]
    rows += [("d", "six long titles", "m", "k", "p", "EUR", 3), ("e", "ten long titles", "m", None, "r", "EUR", 4), ("f", "ten long titles", "n", None, "r", "CHF", 5), ("g", "few long titles", "m", None, None, "EUR", 6), ("h", "few long titles", "m", None, "q", "CHF", 6), ("i", "short", "m", None, "p", "EUR", 1), ("j", "lot long titles", "m", None, "p", None, None)]
    df, seen, real = spark.createDataFrame([(*r, None, None, None) for r in rows], names), [], folding.grouped
    monkeypatch.setattr(folding, "grouped", lambda nodes, pairs: seen.extend(r["node"] for r in nodes.collect()) or real(nodes, pairs))
    got = {r["id"]: (r["offer"], r["copies"]) for r in folding.fold_copies(df).collect()}
    assert sorted(seen) == list("acdefgh")
    assert got == {r[0]: (r[0], 1) for r in rows} | {"c": ("c", 2), "c2": ("c", 2), "e": ("e", 2), "f": ("e", 2), "g": ("g", 2), "h": ("g", 2)}


def test_stored_rows_leave_the_settings_of_the_session(spark):
    before = spark.conf.get(shared.CLEANUP, None)
    assert sorted(r["id"] for r in shared.stored(spark.range(9).repartition(3, "id")).collect()) == list(range(9))
    assert spark.conf.get(shared.CLEANUP, None) == before


@pytest.mark.parametrize("hot", [2048, 2])
def test_no_close_prints_are_left_out_however_few_their_ones(spark, hot):
    prints = [0, 1, 3, 0b111, 0b1111, 0xFF, -1, -2, 0xFFFF, 0x1FFFF, 1, 3, -1]
    df = spark.createDataFrame([*enumerate(prints), (99, None)], "id long, p long")
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    far = lambda p, q: ((p ^ q) & (1 << 64) - 1).bit_count()
    want = {(i, j, far(p, q)) for p, i in first.items() for q, j in first.items() if i < j and far(p, q) <= 3}
    got = [tuple(r) for r in joins.hamming_pairs(df, "id", "p", hot_size=hot).collect()]
    assert len(got) == len(want) == 11 and set(got) == want
    assert sorted(map(tuple, joins.print_copies(df, "id", "p").collect())) == [(1, 10, 0), (2, 11, 0), (6, 12, 0)]


def test_each_copy_of_a_text_is_linked(spark, tmp_path):
    texts = ["red fish", "Fish, red!", "one", "red fish", "", None, "green bird of the far north sings", "green bird of the far north sings"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["hamming_copies"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1, 0), (0, 3, 0), (6, 7, 0)}

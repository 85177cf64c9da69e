"""Rules on small data."""

import collections
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from offerlane.functions import money, text
from offerlane.operators import aggregates, filters, folding, joins
from offerlane.sources import tables
from offerlane.streaming import drops


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_landed_price_adds_duty_and_vat_only_across_the_border(spark):
    price = lambda origin, vehicle: one(spark, money.landed_price(F.lit(15000), F.lit(origin), F.lit(vehicle)))
    assert price("US", False) == 17850 and price("FR", False) == 15000 and price("US", True) == 19635
    assert one(spark, money.landed_price(F.lit(15000), F.lit("US"), F.lit(False), money.ImportRules(enabled=False))) == 15000


def test_money_in_text(spark):
    cases = {"1.234,56 €": 123456, "1,234.56": 123456, "99,99": 9999, "1.234": 123400, "49 000 kr": 4900000, "469.995 kr.": 46999500, "none": None, "19.99": 1999, "12.-": 1200}
    for t, cents in cases.items():
        assert one(spark, money.parse_cents(F.lit(t))) == cents, t


def test_unknown_currency_stays(spark):
    assert one(spark, money.convert(F.lit(100), F.lit("XXX"))) == 100
    assert one(spark, money.convert(F.lit(10000), F.lit("USD"))) == 8620


def test_criteria_keep_what_is_unstated_and_account_for_all(spark):
    df = spark.createDataFrame([(1, 10, None), (2, None, 5), (3, 1, 1), (4, 10, 9)], "id int, a int, b int")
    rules = [filters.Criterion("a", "a", F.col("a") >= 5), filters.Criterion("b", "b", F.col("b") >= 5)]
    got = {r["id"]: r["why"] for r in df.select("id", filters.drop_reason(rules).alias("why")).collect()}
    assert got == {1: None, 2: None, 3: "a", 4: None}
    assert [r["id"] for r in filters.apply_criteria(df, rules, strict=True).collect()] == [4]
    assert {r["id"]: r["u"] for r in df.select("id", filters.unchecked(rules).alias("u")).collect()} == {1: ["b"], 2: ["a"], 3: [], 4: []}


def test_choice_has_four_ways(spark):
    df = spark.createDataFrame([("NEW",), ("USED",), (None,)], "c string")
    keep = lambda choice: {r["c"] for r in df.where(choice.matches(F.col("c"))).collect()}
    assert keep(filters.Choice()) == {"NEW", "USED", None}
    assert keep(filters.Choice(unstated=False)) == {"NEW", "USED"}
    assert keep(filters.Choice(["NEW"])) == {"NEW", None}
    assert keep(filters.Choice(hidden=["NEW"])) == {"USED", None}


def test_round_robin_shows_every_group(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(500)], "pos int, reason string")
    got = [r["reason"] for r in filters.round_robin(df, ["reason"], "pos", 20).collect()]
    assert len(got) == 20 and got.count("small") == 10


def test_upper_median_is_not_interpolated(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10)] + [("b", v) for v in (5, 5, 1)] + [("c", None)], "k string, v int")
    assert {r["k"]: r["middle"] for r in aggregates.upper_median(df, "v", ["k"]).collect()} == {"a": 3, "b": 5}


def test_front_is_what_nothing_beats(spark):
    rows = [(i, c, w) for i, (c, w) in enumerate([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (4, 9), (4, 9), (5, 8)])]
    got = {r["i"] for r in joins.front(spark.createDataFrame([("k", *r) for r in rows], "k string, i int, c int, w int"), ["k"], "c", "w").collect()}
    beats = lambda a, b: a[1] <= b[1] and a[2] >= b[2] and (a[1] < b[1] or a[2] > b[2])
    assert got == {r[0] for r in rows if not any(beats(o, r) for o in rows)}


def test_a_copy_without_a_place_does_not_join_two_places(spark):
    schema = "id string, title string, place string, currency string, price_cents long, first_year int, mileage_km long, power_kw int"
    rows = [("1", "Phone number one X", "munich", "EUR", 100, None, None, None), ("2", "phone NUMBER one-x", None, "CHF", 90, None, None, None), ("3", "Phone number one x", "vienna", "EUR", 100, None, None, None),
            ("4", "Phone number one x", "munich", "EUR", 100, None, None, None), ("5", "short", "a", "EUR", 1, None, None, None), ("6", "short", "a", "EUR", 1, None, None, None), ("7", "Phone number one x", "munich", "EUR", 120, None, None, None)]
    got = {r["id"]: (r["offer"], r["copies"]) for r in folding.fold_copies(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("2", 3), "2": ("2", 3), "4": ("2", 3), "3": ("3", 1), "5": ("5", 1), "6": ("6", 1), "7": ("7", 1)}


def slow_groups(rows):
    """Pair by pair, all members of both groups compared."""
    def close(a, b):
        return abs(a - b) <= max(100, max(a, b) // 100)

    def contradict(a, b):
        both = lambda c: a[c] is not None and b[c] is not None
        return (both("first_year") and a["first_year"] != b["first_year"]) or (both("mileage_km") and not close(a["mileage_km"], b["mileage_km"])) or (both("power_kw") and abs(a["power_kw"] - b["power_kw"]) > 1)

    def apart(a, b):
        if a["place"] is not None and b["place"] is not None and a["place"] != b["place"]:
            return True
        kin = a["family"] is not None and a["family"] == b["family"]
        return contradict(a, b) or (not kin and a["currency"] == b["currency"] and a["price_cents"] != b["price_cents"])

    def words(r):
        return set(re.findall(r"[^\W_]+", r["title"].lower()))

    def match(a, b):
        if a["platform"] == b["platform"] or a["place"] is None or a["place"] != b["place"] or contradict(a, b):
            return False
        x, y = words(a), words(b)
        n = min(len(x), len(y))
        vehicle = a["first_year"] is not None and a["first_year"] == b["first_year"] and a["mileage_km"] is not None and b["mileage_km"] is not None and close(a["mileage_km"], b["mileage_km"])
        return (n >= 3 and len(x & y) >= n * 0.8) or vehicle

    rows = sorted(rows, key=lambda r: r["id"])
    group = {r["id"]: [r] for r in rows}

    def join(a, b):
        x, y = group[a["id"]], group[b["id"]]
        if x is not y and not any(apart(p, q) for p in x for q in y):
            x += y
            for r in y:
                group[r["id"]] = x

    titles, prices = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        titles["".join(re.findall(r"[^\W_]+", r["title"].lower()))].append(r)
        prices[r["currency"], r["price_cents"]].append(r)
    for key, some in titles.items():
        for a, b in itertools.combinations(some, 2) if len(key) >= 12 else ():
            if not apart(a, b):
                join(a, b)
    for some in prices.values():
        for a, b in itertools.combinations(some, 2):
            if match(a, b):
                join(a, b)
    out = {}
    for r in rows:
        members = group[r["id"]]
        out[r["id"]] = (min(members, key=lambda m: (m["price_cents"], m["id"]))["id"], len(members))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_hold_no_two_that_are_apart(spark, seed):
    rng = random.Random(seed)
    titles = ["Crafter 35 hoch lang", "Crafter 35 hoch, lang", "VW Crafter 35 hoch lang AHK", "VW Crafter hoch", "VW", "Sprinter 316 lang hoch"]
    names = "id string, title string, platform string, family string, place string, currency string, price_cents long, first_year int, mileage_km long, power_kw int"
    rows = []
    for i in range(300):
        market = rng.choice(["a", "b", "k1", "k2"])
        rows.append((f"{i:04}", rng.choice(titles), market, "k" if market[0] == "k" else None, rng.choice(["munich", "vienna", "graz", None]), rng.choice(["EUR", "CHF"]), rng.choice([100, 200, 300]), rng.choice([2019, 2020, None, None]), rng.choice([10_000, 10_090, 10_180, 90_000, 90_700, None]), rng.choice([80, 81, 82, None, None])))
    df = spark.createDataFrame(rows, names)
    got = {r["id"]: (r["offer"], r["copies"]) for r in folding.fold_copies(df).collect()}
    want = slow_groups([r.asDict() for r in df.collect()])
    assert got == want
    assert 1 < len({o for o, _ in want.values()}) < 300 and max(n for _, n in want.values()) > 3


def test_folding_odd_rows(spark):
    names = "id string, title string, platform string, place string, currency string, price_cents long, first_year int, mileage_km long, power_kw int, words string, root string"
    rows = [("1", None, None, None, None, None, None, None, None, "x", "y"), ("1", None, None, None, None, None, None, None, None, "x", "y"), ("2", "", "a", "p", "EUR", 5, None, None, None, None, None), ("3", "Some long title here " * 500, "a", "p", "EUR", 5, None, None, None, None, None), ("4", "some LONG title here " * 500, "b", "p", "EUR", 5, None, None, None, None, None)]
    got = sorted((r["id"], r["offer"], r["copies"]) for r in folding.fold_copies(spark.createDataFrame(rows, names)).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "2", 1), ("3", "3", 2), ("4", "3", 2)]
    assert folding.fold_copies(spark.createDataFrame([], names)).count() == 0


def test_drop_steps():
    d = drops.Drop()
    day = 86_400_000_000
    assert [d.step(c, i * day) for i, c in enumerate([100, 90, 80, 85, 100, 100, 95])] == [None, "CUT", "CUT", "PARTLY_RAISED", "CLEARED", None, "CUT"]
    assert (d.pending_from, d.pending_to) == (100, 95)
    assert d.step(50, 100 * day) is None


def test_stream_and_log_agree(spark, tmp_path):
    log = tables.observations(spark, "/root/testdata/sf0.001").cache()
    want = sorted(map(tuple, drops.drops_of_log(log).collect()))
    source = str(tmp_path / "in")
    ordered = log.orderBy("seen", "event_id")
    for i, rows in enumerate((ordered.limit(400), ordered.offset(400).limit(300), ordered.offset(700))):
        rows.coalesce(1).write.parquet(f"{source}/{i}")
    parts = [f"{source}/{i}" for i in range(3)]
    live, out = str(tmp_path / "live"), str(tmp_path / "out")
    for part in parts:
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(live)
        stream = spark.readStream.schema(log.schema).parquet(live)
        q = drops.drops_of_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert want and sorted(map(tuple, spark.read.parquet(out).collect())) == want
    # seen once, and counts by window
    q = drops.first_sightings(spark.readStream.schema(log.schema).parquet(live), "400 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == log.select("search", "offer").distinct().count()
    q = drops.floor_crossings(spark.readStream.schema(log.schema).parquet(live), 5000, "400 days").writeStream.format("memory").queryName("crossed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("crossed").count() == log.where("price_cents >= 5000").select("search", "offer").distinct().count()
    q = drops.windowed_counts(spark.readStream.schema(log.schema).parquet(live)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == log.count()


def test_stores_and_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join([json.dumps({"a": 1}), "{broken", json.dumps({"a": 2})]) + "\n")
    assert {r["a"] for r in tables.read_log(spark, str(p), "a long").collect()} == {1, 2}
    good, bad = tables.read_store(spark, str(p), "a long")
    assert {r["a"] for r in good.collect()} == {1, 2} and [r[0] for r in bad.collect()] == ["{broken"]
    g = tmp_path / "places.tsv"
    g.write_text("\n".join("\t".join([k, str(i), *"x" * 10]) for i, k in enumerate("aab")) + "\nshort\trow\n")
    assert {(r["zip"], r["n"]) for r in tables.read_gazetteer(spark, str(g), ["zip", "n"], "zip").collect()} == {("a", "0"), ("b", "2")}
    out = str(tmp_path / "parts")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "platform string, n int")
    tables.write_partitions(df, out)
    drops.replace_source(spark.createDataFrame([("B", 3)], "platform string, n int"), out)
    assert {(r["platform"], r["n"]) for r in spark.read.parquet(out).collect()} == {("A", 1), ("B", 3)}


def test_texts(spark):
    assert one(spark, text.tidy(F.lit("a\x00b ￼  c "))) == "a b c"
    assert one(spark, text.tokens(F.lit("1.234.567 km, 2 TB SSD"))) == ["1234567", "km", "2tb", "ssd"]
    assert one(spark, text.slug(F.lit("A & B -- C!"))) == "a-and-b-c"
    assert one(spark, text.sizes_gb(F.lit("2TB or 500 gb or 2 tb"))) == [500, 2000]
    assert one(spark, text.says_blocked(text.tokens(F.lit("a play mobil set")), ["playmobil"]))
    assert not one(spark, text.says_blocked(text.tokens(F.lit("")), ["x"]))


def test_search_asks_each_market_and_refuses_unknown_ones(spark):
    import pytest

    from offerlane.sources import markets

    asked = markets.Question("ring", 1000, 9000)
    got = markets.search(spark, "/root/testdata/sf0.001", ["EUROPE", "ASIA"], asked)
    rows = got.collect()
    assert rows and all(100_000 <= r["cents"] <= 900_000 and "ring" in r["title"].lower() and not r["sold"] for r in rows)
    assert {r["platform"] for r in rows} <= {"EUROPE", "ASIA"}
    with pytest.raises(KeyError):
        markets.search(spark, "/root/testdata/sf0.001", ["NOWHERE"], asked)


def test_archives_and_csv_are_read(spark, tmp_path):
    from offerlane.sources import markets

    for i in range(3):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"{i}.json").write_text('{\n "id": %d,\n "name": "n%d"\n}' % (i, i))
    assert {(r["id"], r["name"]) for r in markets.read_archive(spark, str(tmp_path / "a"), "id int, name string").collect()} == {(i, f"n{i}") for i in range(3)}
    (tmp_path / "t.csv").write_text("low,fails\n0,1\nx,2\n2000,3\n")
    assert [tuple(r) for r in markets.read_csv(spark, str(tmp_path / "t.csv"), "low int, fails int").collect()] == [(0, 1), (2000, 3)]
    for n in (2, 5):
        markets.replace_store(spark.range(n), str(tmp_path / "s"))
        assert spark.read.json(str(tmp_path / "s")).count() == n


def test_registry_activates_the_model_that_is_right_held_out(spark):
    from pyspark.sql import functions as F

    from offerlane.operators import registry

    rows = spark.createDataFrame([(i, 100 * (i % 2) + i % 3, i % 2) for i in range(40)], "id long, n_chars long, good int")
    got = registry.scored_by_all(rows, [registry.Length(3000), registry.LearnedBar()], "good", F.col("id") % 5 == 0).collect()
    assert len(got) == 80 and {r["model"] for r in got if r["active"]} == {"learned bar"}


def test_nearest_in_blocks_is_brute_force(spark, monkeypatch):
    import numpy as np

    from offerlane.operators import scoring

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 3) for i in range(60)], "id long, v array<double>, label int")
    monkeypatch.setattr(scoring, "QUERIES", 4)
    monkeypatch.setattr(scoring, "REFERENCES", 7)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = {(r["id"], r["other"]) for r in scoring.nearest(df.where("id % 5 = 0"), df, "id", "v", 3).collect()}
    want = {(i, j) for i in range(0, 60, 5) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:3]}
    assert got == want
    by = {(r["id"], r["by"], r["other"]) for r in scoring.nearest(df.where("id % 5 = 0"), df, "id", "v", 1, by="label").collect()}
    assert by == {(i, c, min((j for j in range(60) if j != i and j % 3 == c), key=lambda j: (-sims[i, j], j))) for i in range(0, 60, 5) for c in range(3)}


def test_prints_of_copies_are_one_row(spark):
    from offerlane.operators import joins

    p = 0x0F0F0F0F0F0F0F0F
    rows = [(i, p) for i in range(300)] + [(1000, p ^ 0b101), (1001, p ^ 0xFFFF), (1002, 3)]
    df = spark.createDataFrame(rows, "id long, p long")
    assert [tuple(r) for r in joins.hamming_pairs(df, "id", "p").collect()] == [(0, 1000, 2)]
    members = {r["id"]: (r["first_id"], r["copies"]) for r in joins.print_members(df, "id", "p").collect()}
    assert members[299] == (0, 300) and members[1000] == (1000, 1) and 1002 not in members
    hashes = spark.createDataFrame([(1, [0b111, 0b110, 0b010]), (2, []), (3, None), (4, [-1]), (5, [1, 2])], "id long, h array<long>")
    assert {r["id"]: r["p"] for r in joins.majority_print(hashes, "id", "h").collect()} == {1: 0b110, 4: -1, 5: 0}


def test_close_prints_with_and_without_hot_keys(spark):
    import random

    from offerlane.operators import joins

    rng, prints = random.Random(5), []
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for _ in range(12)]
    telling = {p: i for i, p in reversed(list(enumerate(prints))) if 16 <= p.bit_count() <= 48}
    want = {(i, j, (p ^ q).bit_count()) for p, i in telling.items() for q, j in telling.items() if i < j and (p ^ q).bit_count() <= 3}
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, p long")
    assert len(want) > 100
    for hot in (1000, 3):
        assert {tuple(r) for r in joins.hamming_pairs(df, "id", "p", hot_size=hot).collect()} == want

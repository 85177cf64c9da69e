"""Memories of searches and devices: hand-written runs, and streams against their batch twins over split and late batches."""

import datetime
import random

import pytest

from offerlane.streaming import memory

T0 = datetime.datetime(2026, 1, 1)


def hours(n):
    return T0 + datetime.timedelta(hours=n)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def judged(known, *rows):
    run = memory.new_run()
    for r in rows:
        memory.add_to_run(run, known, *r)
    return memory.close_run(run, known)


def test_top_offers_by_hand():
    known = {}
    assert judged(known, ("found", "A:1", 0.9, None), ("found", "A:2", 0.8, None), ("found", "A:3", None, None)) == [] and set(known) == {"A:1", "A:2"}
    assert judged(known, ("found", "A:2", 0.7, None)) == [("A:1", "LOST", None)] and known["A:2"]["best"] == 0.8
    assert judged(known, ("found", "A:2", 0.7, None)) == [("A:1", "LOST", None)]  # until it comes back
    assert judged(known, ("found", "A:1", None, None), ("ruled", "A:2", None, "no van")) == [("A:2", "RULED_OUT", "no van")]
    assert judged(known, ("found", "A:1", None, None), ("ruled", "A:2", None, "no van")) == []
    assert judged(known, ("found", "A:1", None, None), ("ruled", "A:2", None, "too far")) == [("A:2", "RULED_OUT", "too far")]
    assert judged(known, ("silent", "A", None, "blocked")) == [("A:1", "LOST", "blocked"), ("A:2", "LOST", "blocked")]
    assert judged(known, ("ad", "A:1", None, "DELETED"), ("ad", "A:2", None, "LIVE")) == [("A:2", "LOST", "LIVE")]
    assert judged(known) == [("A:2", "LOST", None)]  # what is gone isn't missed
    assert judged(known, ("found", "A:1", 0.1, None), ("found", "A:2", 0.1, None)) == [] and known["A:1"]["state"] == "FOUND"
    many = {}
    judged(many, *[("found", f"B:{i:02}", float(i), None) for i in range(30)])
    assert sorted(many) == [f"B:{i}" for i in range(20, 30)]


def streamed(spark, tmp_path, parts, schema, make):
    live, out = str(tmp_path / "live"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(live)
        q = make(spark.readStream.schema(schema).json(live), None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)


def test_missing_offers_over_split_and_late_batches(rocks, tmp_path):
    rng, rows = random.Random(4), []
    for run in range(5):
        for search in ("x", "y"):
            for o in range(25):
                name = f"{'AB'[o % 2]}:{o}"
                kind = rng.choice(["found", "found", "ruled", "ad", None])
                if kind:
                    rows.append((search, hours(run), kind, name, rng.random() if kind == "found" else None, {"ruled": "far", "ad": rng.choice(["LIVE", "DELETED"])}.get(kind)))
            if run == 3:
                rows.append((search, hours(run), "silent", "A", None, "blocked"))
            rows.append((search, hours(run), "end", None, None, None))
    want = sorted(map(tuple, memory.missing_of_log(rocks.createDataFrame(rows, memory.RUNS)).collect()), key=repr)
    assert {w[3] for w in want} == {"LOST", "RULED_OUT"} and {w[0] for w in want} == {"x", "y"}
    late = [("x", hours(0), "found", "A:0", 9.0, None), ("x", hours(0), "end", None, None, None)]
    assert streamed(rocks, tmp_path, [rows[:60], rows[60:65], rows[65:150] + late, rows[150:]], memory.RUNS, memory.missing_of_stream) == want


def test_outbox_by_hand_and_over_batches(rocks, tmp_path):
    rows = [("d", hours(i), "put", i, f"m{i}", hours(i + 3) if i % 2 else None) for i in range(4)]
    rows += [("d", hours(4), "poll", None, None, None), ("d", hours(5), "ack", 1, None, None), ("d", hours(6), "poll", None, None, None), ("d", hours(7), "put", 1, "again", None), ("d", hours(8), "poll", None, None, None)]
    rows += [("e", hours(0), "put", i, "x", None) for i in range(memory.CAP + 5)] + [("e", hours(1), "poll", None, None, None), ("f", hours(1), "poll", None, None, None)]
    df = rocks.createDataFrame(rows, memory.MESSAGES)
    got = sorted(map(tuple, memory.outbox_of_log(df).collect()), key=repr)
    told = {}
    for device, at, seq, _ in got:
        told.setdefault((device, (at - T0).seconds // 3600), []).append(seq)
    assert {k: sorted(v) for k, v in told.items()} == {("d", 4): [0, 2, 3], ("d", 6): [2], ("d", 8): [2], ("e", 1): list(range(5, memory.CAP + 5))}
    assert streamed(rocks, tmp_path, [rows[:2], rows[2:6], rows[6:7], rows[7:]], memory.MESSAGES, memory.outbox_of_stream) == got

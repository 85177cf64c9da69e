"""The linear probe against a plain fit, its gates, and stores that survive a failed write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlane.operators import probe
from offerlane.sources import markets


def plain_fit(x, y, weight, epochs, step, l2):
    mean = x.mean(0)
    c = x - mean
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    k = y.max() + 1
    w, b = np.zeros((k, x.shape[1])), np.zeros(k)
    for _ in range(epochs):
        gw, gb = np.zeros_like(w), np.zeros(k)
        for i in range(len(x)):
            z = w @ c[i] + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            gw += weight[i] * np.outer(p, c[i])
            gb += weight[i] * p
        b -= step * gb / weight.sum()
        w -= step * (gw / weight.sum() + l2 * w)
    return w, b, mean


@pytest.mark.parametrize("items", [False, True])
def test_probe_is_a_plain_fit(spark, items):
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1, 2], [60, 20, 10])
    x = rng.normal(0, 1, (90, 5)) + np.eye(5)[y] * 2
    item = np.arange(90) // 3
    df = spark.createDataFrame([(i, "abc"[y[i]], int(item[i]), x[i].tolist()) for i in range(90)] + [(90, None, 1, [0.0] * 5), (91, "a", 99, None), (92, "a", 98, [1.0])], "id long, label string, item int, v array<double>").repartition(4)
    got = probe.fit(df, "label", "v", "item" if items else None, epochs=12, step=2.0)
    per = np.array([1 / (len(set(item[y == y[i]])) * ((item == item[i]) & (y == y[i])).sum()) if items else 1 / (y == y[i]).sum() for i in range(90)])
    w, b, mean = plain_fit(x, y, per, 12, 2.0, probe.L2)
    assert got.labels == ["a", "b", "c"]
    assert np.allclose(got.weights, w, atol=1e-6) and np.allclose(got.bias, b, atol=1e-6) and np.allclose(got.mean, mean)
    told = {r["id"]: (r["said"], r["score"]) for r in probe.tell(df, got, "id", "v").collect()}
    assert len(told) == 93 and told[91] == told[92] == (None, None)
    p = got.chances(x)
    assert all(told[i][0] == "abc"[p[i].argmax()] and abs(told[i][1] - p[i].max()) < 1e-9 for i in range(90))
    with pytest.raises(ValueError):
        probe.fit(df.where("id = 91"), "label", "v")


def test_gates_of_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(str(t), str(t if rng.random() < q else rng.choice([0, 1, 2])), float(q)) for t in rng.choice([0, 1, 2], 400, p=[0.85, 0.1, 0.05]) for q in [rng.random()]]
    bars = [0.0, 0.3, 0.6, 0.9, 0.97]
    want = {}
    for c in {r[1] for r in rows}:
        enough = max(0.9, 1 - (1 - sum(r[0] == c for r in rows) / len(rows)) / 2)
        for bar in bars:
            over = [r for r in rows if r[1] == c and r[2] >= bar]
            if len(over) >= 5 and sum(r[0] == c for r in over) / len(over) >= enough:
                want[c] = (bar, sum(r[0] == c for r in over) / len(over))
                break
    got = {r["said"]: (r["bar"], r["share"]) for r in probe.class_gates(spark.createDataFrame(rows, "label string, said string, score double"), bars).collect()}
    assert got.keys() == want.keys() and all(abs(got[c][1] - want[c][1]) < 1e-9 and got[c][0] == want[c][0] for c in want) and want


def test_a_store_survives_a_failed_write(spark, tmp_path):
    at = str(tmp_path / "store")
    markets.replace_store(spark.range(3), at)
    with pytest.raises(Exception):
        markets.replace_store(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id")), at)
    assert markets.read_whole_store(spark, at, "id long").count() == 3
    markets.replace_store(spark.range(7), at)
    assert spark.read.json(at).count() == 7 and [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []
    (tmp_path / "store").rename(tmp_path / "store.old-1")  # stopped between the renames
    assert markets.read_whole_store(spark, at, "id long").count() == 7

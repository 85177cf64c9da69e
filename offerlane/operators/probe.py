"""A linear probe over vectors: softmax regression by full-batch gradient descent, each class weighing the same.

Every step is one Spark job: a task adds up the gradient of its rows with one matrix product a batch and yields a row for
each weight; Spark sums these, so the driver sees as many numbers as the model has, however many tasks there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.sources.shared import checkpointed

EPOCHS, STEP, L2 = 400, 4.0, 1e-3
#: Classes that a probe may have (the model, classes times dimensions, is held by the driver and each task).
CLASSES = 1_000


@dataclass(frozen=True)
class Probe:
    labels: list
    weights: np.ndarray
    bias: np.ndarray
    mean: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Vectors without what all have in common, at unit length (zero stays zero)."""
        c = x - self.mean
        size = np.sqrt((c * c).sum(1, keepdims=True))
        return c / np.where(size > 0, size, 1.0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.centred(x) @ self.weights.T + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, size)


def _cells(values: np.ndarray) -> pa.RecordBatch:
    at = np.arange(values.size)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(values.ravel())], ["cell", "value"])


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the arrays that run yields in each task, cell by cell."""
    out = np.zeros(size)
    for r in rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # size rows
        out[r["cell"]] = r["value"]
    return out


def fit(rows: DataFrame, label: str, vector: str, item: str | None = None, epochs: int = EPOCHS, step: float = STEP, l2: float = L2) -> Probe:
    """A probe for rows(label, vector, ...). All items of a label weigh together what any label's do, and all rows of an item
    together what any item's of its label do; without `item` each row is one. Rows without label or vector, or with a vector
    of another length than most, aren't learned from. No rows is an error."""
    own = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"), (F.col(item) if item else F.monotonically_increasing_id()).alias("item"))
    own = checkpointed(own)
    sizes = own.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None or not sizes["size"]:
        raise ValueError("nothing to learn from")
    size = sizes["size"]
    own = own.where(F.size("x") == size)
    each = own.groupBy("label", "item").agg(F.count(F.lit(1)).alias("n"))
    items = {r["label"]: r["items"] for r in each.groupBy("label").agg(F.count(F.lit(1)).alias("items")).limit(CLASSES + 1).collect()}
    if len(items) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    labels = sorted(items)
    places = own.sparkSession.createDataFrame([(v, i, items[v]) for i, v in enumerate(labels)], f"label {own.schema['label'].dataType.simpleString()}, y int, items long")
    weighed = own.join(F.broadcast(places), "label") if item is None else own.join(each, ["label", "item"]).join(F.broadcast(places), "label")
    share = F.lit(1.0) / F.col("items") if item is None else F.lit(1.0) / (F.col("items") * F.col("n"))
    data = checkpointed(weighed.select("x", "y", share.alias("weight")))

    def add(batches):
        held = np.zeros(size + 1)
        for b in batches:
            x = _matrix(b.column(0), size)
            held[:size] += x.sum(0)
            held[size] += len(x)
        yield _cells(held)

    total = _summed(data.select("x"), add, size + 1)
    probe = Probe(labels, np.zeros((len(labels), size)), np.zeros(len(labels)), total[:size] / total[size])
    for _ in range(epochs):

        def gradient(batches, probe=probe):
            held = np.zeros((len(labels), size + 1))
            for b in batches:
                x, y, w = _matrix(b.column(0), size), b.column(1).to_numpy(), b.column(2).to_numpy()
                g = probe.chances(x)
                g[np.arange(len(y)), y] -= 1.0
                g *= w[:, None]
                held[:, :size] += g.T @ probe.centred(x)
                held[:, size] += g.sum(0)
            yield _cells(held)

        # the weights of all rows add up to the number of classes
        g = _summed(data, gradient, len(labels) * (size + 1)).reshape(len(labels), size + 1) / len(labels)
        probe = Probe(labels, probe.weights - step * (g[:, :size] + l2 * probe.weights), probe.bias - step * g[:, size], probe.mean)
    return probe


def tell(rows: DataFrame, probe: Probe, id_col: str, vector: str) -> DataFrame:
    """(id, said, score): the likeliest label of each row and its chance, null for rows whose vector is null or of another
    length. One pass, no shuffle."""
    size, kind = len(probe.mean), rows.schema[id_col].dataType.simpleString()
    label_type = "string" if isinstance(probe.labels[0], str) else "long"

    def run(batches):
        for b in batches:
            sizes = np.array([-1 if v is None else len(v) for v in b.column(1).to_pylist()])
            able = np.flatnonzero(sizes == size)
            said, score = [None] * len(sizes), [None] * len(sizes)
            if len(able):
                p = probe.chances(_matrix(b.column(1).take(pa.array(able)), size))
                best = p.argmax(1)
                for i, k, s in zip(able.tolist(), best.tolist(), p[np.arange(len(able)), best].tolist()):
                    said[i], score[i] = probe.labels[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string() if label_type == "string" else pa.int64()), pa.array(score, pa.float64())], [id_col, "said", "score"])

    return rows.select(id_col, F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, f"{id_col} {kind}, said {label_type}, score double")


def class_gates(told: DataFrame, bars: list[float], least: int = 5, right: float = 0.9) -> DataFrame:
    """told(label, said, score) -> (said, bar, share): for each class the lowest bar from which on it is said at least
    `least` times and right often enough: `right`, and with at most half the mistakes that always saying it would make.
    Classes without such a bar are left out. Counts for all bars come from one pass."""
    total = told.agg(F.count(F.lit(1)).alias("all"))
    base = told.groupBy(F.col("label").alias("said")).agg(F.count(F.lit(1)).alias("own"))
    # a row counts for every bar up to its score, so the number of bars it reaches is enough to shuffle
    reached = sum((F.col("score") >= b).cast("int") for b in bars)
    counted = told.groupBy("said", reached.alias("reached")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("said")).cast("long")).alias("hits"))
    each = counted.select("said", "n", "hits", F.explode(F.slice(F.array(*map(F.lit, sorted(bars))), F.lit(1), F.col("reached"))).alias("bar")).groupBy("said", "bar").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    rows = each.join(base, "said", "left").join(F.broadcast(total))  # one row
    enough = F.greatest(F.lit(right), 1 - (1 - F.coalesce("own", F.lit(0)) / F.col("all")) / 2)
    share = F.col("hits") / F.col("n")
    kept = rows.where((F.col("n") >= least) & (share >= enough)).groupBy("said").agg(F.min(F.struct("bar", share.alias("share"))).alias("g"))
    return kept.select("said", "g.bar", "g.share")

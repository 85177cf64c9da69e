"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all training texts. The weights are learned by follow-the-regularised-leader
with an elastic-net penalty from a bounded sample, and a temperature, fitted to a part of the sample that the weights
haven't seen, calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import chunks, fold, ship, texts_of

BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: Training texts for each language, about: those whose hash lies below the share that this is of the language's rows.
TRAIN_EACH = 800
#: Languages at most: the model has BUCKETS weights for each.
CLASSES = 500
EPOCHS, BATCH = 4, 32
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
_LETTER = regex.compile(r"\p{L}")


def counts_of(texts: list[bytes]) -> np.ndarray:
    """How often each bucket's n-grams stand in each lower-cased text (texts x BUCKETS). A text is flanked by blanks."""
    points = [np.frombuffer((" " + t.decode("utf-8").lower() + " ").encode("utf-32-le"), np.uint32) for t in texts]
    body = np.concatenate(points).astype(np.uint64)
    sizes = np.array([len(p) for p in points])
    row = np.repeat(np.arange(len(texts)), sizes)
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    h = np.zeros(len(body), np.uint64)
    for n in ORDERS:
        h = (h[: len(body) - n + 1] + body[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inside = row[: len(h)] == row[n - 1 :]
        total += np.bincount((row[: len(h)] * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64))[inside], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def _tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Weights (BUCKETS x classes) by FTRL-proximal steps over mini-batches; L1 keeps small ones at zero."""
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    w, order = np.zeros_like(z), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for at in np.array_split(order.permutation(len(x)), max(1, len(x) // BATCH)):
            p = _softmax(x[at] @ w)
            p[np.arange(len(at)), y[at]] -= 1
            g = x[at].T @ p
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)
    return w


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which the true classes are likeliest (golden-section search)."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """A language and its probability for each text; und and 0 for a text without a letter."""
        names, best = ["und"] * len(texts), np.zeros(len(texts))
        for a, b in chunks(texts):
            for i in range(a, b, 256):
                some = [k for k in range(i, min(i + 256, b)) if _LETTER.search(texts[k].decode("utf-8"))]
                if some:
                    p = _softmax(_tf_idf(counts_of([texts[k] for k in some]), self.idf) @ self.weights / self.temperature)
                    for k, c, v in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
                        names[k], best[k] = self.classes[c], v
        return names, best


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = TRAIN_EACH) -> Model | None:
    """Of rows with an id, a text and a language whose crc32(doc_id) mod 4 isn't 2. None without any; an error if there are
    more than CLASSES languages.

    The weights are learned from about `each` texts a language, those whose hash lies below a share, and twice as many at
    most: of more, those with the smallest hashes. Rows that repeat both id and text count once there."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    rows = rows.where(fold("doc_id", 4) != 2)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(CLASSES + 1).collect()}  # a row for each language
    if not sizes:
        return None
    if len(sizes) > CLASSES:
        raise ValueError(f"more than {CLASSES} languages: is {lang_col} a language?")

    def frequencies(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = texts_of(b.column(0))
            for x, y in chunks(texts):
                for i in range(x, y, 256):
                    df += (counts_of(texts[i : min(i + 256, y)]) > 0).sum(0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS), pa.int32()), pa.array(np.append(n, df))], ["bucket", "df"])

    found = rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(1)
    classes = sorted(sizes)
    drawn = F.xxhash64("doc_id", "text")
    u = (F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)) < F.element_at(F.create_map(*[F.lit(v) for c in classes for v in (c, min(1.0, each / sizes[c]))]), F.col("lang"))

    def sparse(batches):
        for b in batches:
            texts = texts_of(b.column(0))
            langs = b.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                c = counts_of(texts[i : i + 64])
                held = [np.flatnonzero(r) for r in c]
                yield pa.RecordBatch.from_arrays([pa.array(langs[i : i + 64]), pa.array([h.astype("<i4").tobytes() for h in held], pa.binary()), pa.array([r[h].astype("<i4").tobytes() for r, h in zip(c, held)], pa.binary())], ["lang", "at", "n"])

    chosen = rows.where(u).select("text", "lang", drawn.alias("drawn")).dropDuplicates(["drawn", "lang"]).orderBy("drawn", "lang").limit(2 * each * len(classes))
    sample = chosen.select("text", "lang").mapInArrow(sparse, "lang string, at binary, n binary").collect()
    sample = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in sample)
    if not sample:
        return None
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for i, (_, at, n) in enumerate(sample):
        x[i, np.frombuffer(at, "<i4")] = np.frombuffer(n, "<i4")
    x, y = _tf_idf(x, idf), np.array([classes.index(s[0]) for s in sample])
    held = np.arange(len(x)) % 5 == 4
    w = ftrl(x[~held], y[~held], len(classes))
    return Model(classes, idf, w.astype(np.float32), temperature(x[held] @ w, y[held]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs, repeated rows too.

    Texts that are null or have no letter are und, with score 0; so are all if there is nothing to learn from.
    held_out is false for a null id. Other columns of docs aren't read.
    """
    ship(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col)

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            names, best = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

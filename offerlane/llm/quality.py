"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, of it and of the lines before and after it;
transitions link neighbours. Forward-backward marginals of all lines, weighted by the lines' lengths, make the score of a
document. The field is fitted to documents whose quality label is given to all their lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import chunks, flat, fold, run_hashes, runs_of, ship, texts_of

#: Labelled documents that the field is fitted to, at most: those with the smallest hash of their id.
TRAIN_DOCS = 4000
#: Lines that a document of the sample may have (longer ones are scored, but not learned from), so that it is bounded.
TRAIN_DOC_LINES = 512
#: Lines in a training sequence; longer documents are several sequences.
TRAIN_LINES = 64
STEPS, RATE, PENALTY = 120, 0.1, 1e-3
THRESHOLD = 0.3

# kinds of bytes: 0 other control, 1 a-z and non-ASCII, 2 A-Z, 3 digit, 4 space, 5 . , 6 ! 7 ? ; : ' " - ( ), 8 |, 9 rest
_KINDS = 10
_KIND = np.zeros(256, np.int64)
for _k, _chars in ((1, bytes(range(97, 123)) + bytes(range(128, 256))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b" \t"), (5, b".,"), (6, b"!"), (7, b"?;:'\"-()"), (8, b"|"), (9, b"#$%&*+/<=>@[\\]^_`{}~")):
    _KIND[list(_chars)] = _k
OWN = _KINDS + 5  # shares, word length, length, words like the one before, distinct words, sameness with the line before
FEATURES = 3 * OWN


def _repetition(body: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the share of its words that are like the word before, and that of its distinct words."""
    blank = (body == 32) | (body == 9) | (body == 10) | (body == 13)
    begins, ends = runs_of(blank)
    if not len(begins):
        return np.zeros(n_lines), np.ones(n_lines)
    word = run_hashes(body, begins, ends)
    of = line[begins]
    n = np.bincount(of, minlength=n_lines)
    like = np.append(False, (word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    _, first = np.unique(word ^ ((of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
    n_one = np.maximum(n, 1)
    return np.bincount(of, like, minlength=n_lines) / n_one, np.where(n > 0, np.bincount(of[first], minlength=n_lines) / n_one, 1)


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all lines of the texts, their lengths in bytes, and how many lines each text has. Lines end at \\n;
    lines without a byte are no lines."""
    body, ends = flat([t + b"\n" for t in texts])
    stops = np.flatnonzero(body == 10)
    starts = np.append(0, stops[:-1] + 1)
    size = stops - starts
    text_of = np.searchsorted(ends, stops, side="right")
    line = np.repeat(np.arange(len(stops)), size + 1)
    kinds = np.bincount(line * _KINDS + _KIND[body], minlength=len(stops) * _KINDS).reshape(-1, _KINDS)
    kinds[:, 0] -= 1  # the line feed itself
    like, distinct = _repetition(body, line, len(stops))
    keep = size > 0
    like, distinct = like[keep], distinct[keep]
    kinds, size, text_of = kinds[keep].astype(np.float64), size[keep], text_of[keep]
    share = kinds / np.maximum(size, 1)[:, None]
    words = kinds[:, 4] + 1
    own = np.column_stack((share, np.log1p(size / words), np.log1p(size) / 5, like, distinct, np.zeros(len(size))))
    first = np.append(True, text_of[1:] != text_of[:-1]) if len(size) else np.zeros(0, bool)
    if len(size) > 1:
        own[1:, -1] = np.where(first[1:], 0, np.exp(-10 * np.abs(share[1:] - share[:-1]).sum(1)))
    before = np.vstack((np.zeros((1, OWN)), own[:-1])) * ~first[:, None] if len(size) else own
    last = np.append(first[1:], True) if len(size) else first
    after = np.vstack((own[1:], np.zeros((1, OWN)))) * ~last[:, None] if len(size) else own
    return np.hstack((own, before, after)), size, np.bincount(text_of, minlength=len(texts))


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length; for each step t, the rows of those longer than t are offsets[t'] + t."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    active = np.array([np.searchsorted(-counts[order], -t, side="left") for t in range(int(counts.max(initial=0)))], np.int64)
    return order, starts, active


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # FEATURES + 1 (bias): evidence for good
    moves: np.ndarray  # 2 x 2

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def marginals(self, e: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of every line; with pairs, also the expected moves (2 x 2) and the sequences' log partition."""
        _, starts, active = _padded(counts)
        n, steps = len(e), len(active)
        emit = np.stack((np.zeros(n), e), 1)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        log_add = np.logaddexp
        for t in range(steps):
            rows = starts[: active[t]] + t
            forward[rows] = emit[rows] + (log_add(forward[rows - 1, :1] + self.moves[0], forward[rows - 1, 1:] + self.moves[1]) if t else 0)
        for t in range(steps - 2, -1, -1):
            rows = starts[: active[t + 1]] + t
            ahead = emit[rows + 1] + backward[rows + 1]
            backward[rows] = log_add(ahead[:, :1] + self.moves[:, 0], ahead[:, 1:] + self.moves[:, 1])
        both = forward + backward
        total = log_add(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        if not pairs:
            return good
        expected = np.zeros((2, 2))
        for t in range(1, steps):
            rows = starts[: active[t]] + t
            for a in (0, 1):
                for b in (0, 1):
                    expected[a, b] += np.exp(forward[rows - 1, a] + self.moves[a, b] + emit[rows, b] + backward[rows, b] - total[rows]).sum()
        first = starts[: active[0]] if steps else np.zeros(0, np.int64)
        return good, expected, total[first]


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Sequences of counts lines each, every line of sequence i labelled labels[i]; Adam on the mean log-likelihood."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    field = Field(mean, scale, np.zeros(FEATURES + 1), np.zeros((2, 2)))
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    y = np.repeat(labels, counts).astype(float)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = np.maximum(counts[labels == label] - 1, 0).sum()
    at = np.zeros(FEATURES + 5)
    m, v = np.zeros_like(at), np.zeros_like(at)
    for k in range(1, STEPS + 1):
        field.weights, field.moves = at[: FEATURES + 1], at[FEATURES + 1 :].reshape(2, 2)
        good, moves, _ = field.marginals(z @ field.weights, counts, pairs=True)
        g = np.concatenate((z.T @ (good - y), (moves - seen).ravel())) / len(y) + PENALTY * at
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field.weights, field.moves = at[: FEATURES + 1], at[FEATURES + 1 :].reshape(2, 2)
    return field


def _sequences(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts cut into at most `most` each, and which of the counts each piece belongs to."""
    pieces = [(min(most, int(n) - a), i) for i, n in enumerate(counts) for a in range(0, int(n), most)]
    return np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Field | None:
    """The field of at most `most` labelled documents outside the held-out fold (crc32(doc_id) mod 5 = 0): those whose
    id has the smallest hash. Null ids and labels are left out; an id with several labels takes the smallest, one with
    several texts the least of them. None if there is nothing of both labels to learn from."""
    ship(docs.sparkSession)
    mine = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    mine = mine.groupBy("label_id").agg(F.min("label").alias("label")).where(fold("label_id", 5) != 0).orderBy(F.xxhash64("label_id"), "label_id").limit(most)

    def measure(batches):
        for b in batches:
            labels, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for a, z in chunks(texts):
                x, _, counts = lines_of(texts[a:z])
                cuts = np.append(0, np.cumsum(counts))
                cuts = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(labels[a:z], pa.int32()), pa.array([x[s:e].astype(np.float32).tobytes() if e - s <= TRAIN_DOC_LINES else b"" for s, e in cuts], pa.binary())], ["label", "x"])

    wanted = F.broadcast(mine)  # at most `most` rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text").mapInArrow(measure, "label int, x binary").collect()
    rows = sorted((r["label"], bytes(r["x"])) for r in rows if r["x"])
    if len({r[0] for r in rows}) < 2:
        return None
    parts = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    counts, of = _sequences(np.array([len(p) for p in parts]), TRAIN_LINES)
    return fit(np.concatenate(parts).astype(np.float64), counts, np.array([r[0] for r in rows])[of])


def score_texts(field: Field | None, texts: list[bytes]) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for a text without lines, or where nothing was learned."""
    out = np.zeros(len(texts))
    if field is None:
        return out
    for a, z in chunks(texts):
        x, size, counts = lines_of(texts[a:z])
        if len(x):
            good = field.marginals(field.evidence(x), counts)
            of = np.repeat(np.arange(z - a), counts)
            total = np.bincount(of, size, minlength=z - a)
            out[a:z] = np.where(total > 0, np.bincount(of, size * good, minlength=z - a) / np.maximum(total, 1), 0)
    return np.clip(out, 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs, repeated rows too.

    Only texts are scored; null and empty texts score 0. held_out is false for a null id. Without labels of both kinds
    all score 0. Other columns of docs aren't read.
    """
    field = train(docs, labels, id_col, text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(field, texts_of(b.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, of the documents that score at least threshold."""
    field = train(docs, labels, text_col=text_col)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(field, [(t or "").encode() for t in texts]) >= threshold)

    return docs.where(good(F.col(text_col)))

"""Scoring models that can be plugged in, trained and compared."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScoringModel(Protocol):
    name: str

    def train(self, rows: DataFrame, label: str) -> ScoringModel: ...

    def score(self) -> Column:
        """0 to 1, from a row's columns."""
        ...


@dataclass(frozen=True)
class Length:
    """The longer, the better, up to so many characters."""

    most: int
    name: str = "length"

    def train(self, rows: DataFrame, label: str) -> Length:
        return self

    def score(self) -> Column:
        return F.least(F.lit(1.0), F.col("n_chars") / float(self.most))


@dataclass(frozen=True)
class LearnedBar:
    """Good from the mean length of the good ones on."""

    bar: float | None = field(default=None)
    name: str = "learned bar"

    def train(self, rows: DataFrame, label: str) -> LearnedBar:
        return LearnedBar(rows.where(F.col(label) == 1).agg(F.avg("n_chars").alias("t")).first()["t"])

    def score(self) -> Column:
        return F.when(F.col("n_chars") >= F.lit(self.bar), 1.0).otherwise(0.0) if self.bar is not None else F.lit(0.5)


def scored_by_all(rows: DataFrame, models: list[ScoringModel], label: str, held_out: Column) -> DataFrame:
    """rows with model, score and active: every model, trained on the rows that aren't held out, scores each row in one
    pass; the active one is right most often on those that are (ties by name)."""
    trained = [m.train(rows.where(~held_out), label) for m in models]
    scores = F.array(*(F.struct(F.lit(m.name).alias("model"), m.score().cast("double").alias("score")) for m in trained))
    scored = rows.withColumn("_s", F.explode(scores)).select(*rows.columns, "_s.model", "_s.score")
    right = ((F.col("score") >= 0.5) == (F.col(label) == 1)).cast("int")
    accuracy = scored.where(held_out).groupBy("model").agg(F.avg(right).alias("a")).collect()  # a row for each model
    best = min(accuracy, key=lambda r: (-r["a"], r["model"]))["model"] if accuracy else None
    return scored.withColumn("active", F.col("model") == F.lit(best))


"""Price drops and change logs as state machines: once over a stream, once over a whole log.

Both run the same step for each observation of an offer, in order of time. The stream keeps a few numbers for each
(search, offer); the batch form sorts a key's rows inside the shuffle's partitions and walks them as they come, so no
key's rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days after which an offer that wasn't seen again is forgotten.
MEMORY_DAYS = 60
_DAY = 86_400_000_000
OUT = "search string, offer long, seen timestamp_ntz, event string, from_cents long, to_cents long"
_STATE = "last long, pending_from long, pending_to long, at long"


@dataclass
class Drop:
    """last: the price seen last. pending: the drop not cleared yet, from the price before the first cut."""

    last: int | None = None
    pending_from: int | None = None
    pending_to: int | None = None
    at: int = 0

    def step(self, cents: int, at: int) -> str | None:
        """CUT, PARTLY_RAISED or CLEARED, where that is what this observation means."""
        if self.last is not None and at - self.at >= MEMORY_DAYS * _DAY:
            self.last = None
        before, self.last, self.at = self.last, cents, at
        if before is None or cents == before:
            return None
        if cents < before:
            start = self.pending_from if self.pending_from is not None else before
            if cents < start:
                self.pending_from, self.pending_to = start, cents
                return "CUT"
            self.pending_from = self.pending_to = None
            return "CLEARED"
        if self.pending_from is None:
            return None
        if cents >= self.pending_from:
            self.pending_from = self.pending_to = None
            return "CLEARED"
        self.pending_to = cents
        return "PARTLY_RAISED"


def _micros(seen: pd.Series) -> pd.Series:
    return seen.astype("datetime64[us]").astype("int64")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["search", "offer", "seen", "event", "from_cents", "to_cents"]).astype({"from_cents": "Int64", "to_cents": "Int64"})


def drops_of_log(log: DataFrame) -> DataFrame:
    """log(search, offer, seen, event_id, price_cents) -> a row for each CUT, PARTLY_RAISED and CLEARED."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Drop()
        for pdf in frames:
            out = []
            for search, offer, seen, at, cents in zip(pdf["search"], pdf["offer"], pdf["seen"], _micros(pdf["seen"]), pdf["price_cents"]):
                if (search, offer) != key:
                    key, state = (search, offer), Drop()
                start = state.pending_from
                if (event := state.step(int(cents), int(at))) is not None:
                    out.append((search, offer, seen, event, state.pending_from if state.pending_from is not None else start, int(cents)))
            yield _rows(out)

    rows = log.where("price_cents is not null and seen is not null").select("search", "offer", "seen", "event_id", "price_cents")
    return rows.repartition("search", "offer").sortWithinPartitions("search", "offer", "seen", "event_id").mapInPandas(walk, OUT)


def drops_of_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same over a stream, whose micro-batches hold observations in order of time. What comes later than the delay
    allows is left out; an offer's state goes when event time has passed its memory."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        d = Drop(*(None if v is None or pd.isna(v) else int(v) for v in state.get)) if state.exists else Drop()
        out = []
        for pdf in sorted((f for f in frames), key=lambda f: f["seen"].iloc[0] if len(f) else pd.Timestamp(0)):
            pdf = pdf.sort_values(["seen", "event_id"], kind="stable")
            for seen, at, cents in zip(pdf["seen"], _micros(pdf["seen"]), pdf["price_cents"]):
                start = d.pending_from
                if (event := d.step(int(cents), int(at))) is not None:
                    out.append((key[0], key[1], seen, event, d.pending_from if d.pending_from is not None else start, int(cents)))
        state.update((d.last, d.pending_from, d.pending_to, d.at))
        state.setTimeoutTimestamp(max(d.at // 1000, state.getCurrentWatermarkMs()) + MEMORY_DAYS * 86_400_000)
        yield _rows(out)

    rows = stream.where("price_cents is not null and seen is not null").withColumn("_t", F.col("seen").cast("timestamp")).withWatermark("_t", delay)
    return rows.groupBy("search", "offer").applyInPandasWithState(update, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_sightings(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (search, offer) once in a stream; what a search saw more than the delay ago is forgotten."""
    timed = stream.withColumn("_t", F.col("seen").cast("timestamp")).withWatermark("_t", delay)
    return timed.dropDuplicatesWithinWatermark(["search", "offer"]).drop("_t")


def floor_crossings(stream: DataFrame, floor_cents: int, delay: str = "1 day") -> DataFrame:
    """Offers of a stream the first time that they reach the floor, each once; what reached it more than the delay ago is
    forgotten."""
    return first_sightings(stream.where(F.col("price_cents") >= floor_cents), delay)


def windowed_counts(stream: DataFrame, width: str = "6 hours", delay: str = "1 day") -> DataFrame:
    timed = stream.withColumn("_t", F.col("seen").cast("timestamp")).withWatermark("_t", delay)
    g = timed.groupBy("search", F.window("_t", width)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("search", F.col("window.start").cast("timestamp_ntz").alias("began"), "n")


def replace_source(batch: DataFrame, path: str, source: str = "platform") -> None:
    """For foreachBatch: a source's answer replaces what it said before; other sources' rows stay."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)

"""What searches and devices remember between runs: the best offers a search ever had, and messages not acknowledged yet.

Each is a small state with a step for each row, kept by Structured Streaming (transformWithState: a value with a time to
live) and walked over a whole log by the batch form. A run's rows may be split over micro-batches in any way: a run is
judged when its end is told, and rows that come after that are late and say nothing. What is kept of an open run is bounded:
its ten best offers, and what it says of offers that are remembered already.

The session has to keep state in RocksDB: spark.sql.streaming.stateStore.providerClass, with
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How far down a run's ranking offers are remembered from, messages that a device keeps, and days of memory.
TOP, CAP, MEMORY_DAYS = 10, 200, 365
RUNS = "search string, run timestamp, kind string, offer string, score double, detail string"
MISSING = "search string, run timestamp, offer string, state string, why string"
MESSAGES = "device string, at timestamp, kind string, seq long, body string, expires timestamp"
SENT = "device string, at timestamp, seq long, body string"


def new_run() -> dict:
    return {"best": [], "found": [], "rules": {}, "silent": {}, "ads": {}}


def add_to_run(run: dict, known: dict, kind: str, offer: str | None, score: float | None, detail: str | None) -> None:
    """kind: found (with a score where it was ranked), ruled (detail: the rule), ad (detail: what its page says), silent
    (offer: a source that gave no answer, detail: why)."""
    if kind == "silent":
        run["silent"][offer] = detail
    elif kind == "found":
        if score is not None and offer not in (o for _, o in run["best"]):
            run["best"] = sorted([*map(tuple, run["best"]), (score, offer)], key=lambda b: (-b[0], b[1]))[:TOP]
        if offer in known and offer not in run["found"]:
            run["found"].append(offer)
    elif offer in known:
        run["rules" if kind == "ruled" else "ads"][offer] = detail


def close_run(run: dict, known: dict) -> list[tuple[str, str, str | None]]:
    """Judge a run: what is remembered is brought up to date, and (offer, state, why) of what the run reports missing: all that
    is lost, and what a rule removed that hadn't before."""
    for score, offer in run["best"]:
        before = known.get(offer, {})
        known[offer] = {"best": max(score, before.get("best", score)), "state": "FOUND"}
    here = {*run["found"], *(o for _, o in run["best"])}
    out = []
    for offer, o in sorted(known.items()):
        if offer in here:
            o |= {"state": "FOUND", "rule": None}
            continue
        if o["state"] == "GONE":
            continue
        rule, silent = run["rules"].get(offer), run["silent"].get(offer.split(":")[0])
        if rule is not None:
            if o["state"] != "RULED_OUT" or o.get("rule") != rule:
                out.append((offer, "RULED_OUT", rule))
            o |= {"state": "RULED_OUT", "rule": rule}
        elif silent is not None:
            o |= {"state": "LOST", "rule": None}
            out.append((offer, "LOST", silent))
        else:
            ad = run["ads"].get(offer)
            o |= {"state": "GONE" if ad == "DELETED" else "LOST", "rule": None}
            if ad != "DELETED":
                out.append((offer, "LOST", ad))
    return out


def _run_rows(pdf: pd.DataFrame) -> list[tuple]:
    """Rows by run, what a run's end says last."""
    rows = pdf.assign(_end=pdf["kind"] == "end").sort_values(["run", "_end"], kind="stable")
    clean = rows.astype(object).where(rows.notna(), None)
    return list(clean[["run", "kind", "offer", "score", "detail"]].itertuples(index=False, name=None))


class TopMemory(StatefulProcessor):
    """State of a search: what it remembers (an offer each), its open runs, and the last run that was judged, as JSON."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "told string", self.days and self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = json.loads(self.memory.get()[0]) if self.memory.exists() else {"known": {}, "runs": {}, "last": None}
        known, runs, last, out = held["known"], {pd.Timestamp(k): v for k, v in held["runs"].items()}, held["last"] and pd.Timestamp(held["last"]), []
        for at, kind, offer, score, detail in _run_rows(pd.concat(list(rows))):
            if last is not None and at <= last:
                continue
            if kind == "end":
                out += [(key[0], at, *r) for r in close_run(runs.pop(at, new_run()), known)]
                runs, last = {k: v for k, v in runs.items() if k > at}, at
            else:
                add_to_run(runs.setdefault(at, new_run()), known, kind, offer, score, detail)
        self.memory.update((json.dumps({"known": known, "runs": {str(k): v for k, v in runs.items()}, "last": last and str(last)}),))
        yield pd.DataFrame(out, columns=["search", "run", "offer", "state", "why"]).astype({"run": "datetime64[us]"})

    def close(self) -> None:
        pass


def missing_of_stream(runs: DataFrame, days: int | None = MEMORY_DAYS) -> DataFrame:
    """A stream of runs' rows (RUNS) -> what each run reports missing (MISSING). Runs of a search end in order of time; a run
    that has not ended when a later one has is given up. What wasn't touched for so many days is forgotten; a stream that is to
    end by itself (a trigger of what is available now) has to keep everything: days=None."""
    return runs.where("search is not null and run is not null").groupBy("search").transformWithStateInPandas(statefulProcessor=TopMemory(days), outputStructType=MISSING, outputMode="Append", timeMode="ProcessingTime" if days else "None")


def missing_of_log(runs: DataFrame) -> DataFrame:
    """The same over a whole log, in which each run's rows come before its end. A search's rows are walked as they come, sorted
    by run; only its memory and its ten best are held."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, run = None, {}, (None, new_run())
        for pdf in frames:
            clean, out = pdf.astype(object).where(pdf.notna(), None), []
            for search, at, kind, offer, score, detail in clean[["search", "run", "kind", "offer", "score", "detail"]].itertuples(index=False, name=None):
                if search != now:
                    now, known, run = search, {}, (None, new_run())
                if at != run[0]:
                    run = (at, new_run())
                if kind == "end":
                    out += [(search, at, *r) for r in close_run(run[1], known)]
                else:
                    add_to_run(run[1], known, kind, offer, score, detail)
            yield pd.DataFrame(out, columns=["search", "run", "offer", "state", "why"]).astype({"run": "datetime64[us]"})

    rows = runs.where("search is not null and run is not null").withColumn("_end", F.col("kind") == "end")
    rows = rows.repartition("search").sortWithinPartitions("search", "run", "_end", "kind", F.desc("score"), "offer")
    return rows.drop("_end").mapInPandas(walk, MISSING)


def outbox_step(held: dict[int, tuple], acked: int, at, kind: str, seq: int | None, body: str | None, expires) -> tuple[int, list[tuple[int, str]]]:
    """put: keep a message that isn't acknowledged yet, but no more than CAP, the newest ones. ack: all up to seq have arrived.
    poll: tell all that is held and hasn't expired, in order; they stay held, so a message is delivered at least once."""
    if kind == "ack":
        acked = max(acked, seq)
        for s in [s for s in held if s <= acked]:
            del held[s]
    elif kind == "put" and seq > acked:
        held[seq] = (body, expires)
        for s in sorted(held)[:-CAP]:
            del held[s]
    elif kind == "poll":
        for s in [s for s, (_, end) in held.items() if end is not None and end <= at]:
            del held[s]
        return acked, [(s, held[s][0]) for s in sorted(held)]
    return acked, []


class Outbox(StatefulProcessor):
    """State of a device: its messages by number (CAP at most), and the number up to which it has acknowledged, as JSON."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "told string", self.days and self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        acked, told = json.loads(self.memory.get()[0]) if self.memory.exists() else (-1, [])
        held, out = {seq: (body, end and pd.Timestamp(end)) for seq, body, end in told}, []
        pdf = pd.concat(list(rows)).sort_values("at", kind="stable")
        clean = pdf.astype(object).where(pdf.notna(), None)
        for at, kind, seq, body, expires in clean[["at", "kind", "seq", "body", "expires"]].itertuples(index=False, name=None):
            acked, sent = outbox_step(held, acked, at, kind, None if seq is None else int(seq), body, expires)
            out += [(key[0], at, *t) for t in sent]
        self.memory.update((json.dumps([acked, [[seq, body, end and str(end)] for seq, (body, end) in held.items()]]),))
        yield pd.DataFrame(out, columns=["device", "at", "seq", "body"]).astype({"at": "datetime64[us]"})

    def close(self) -> None:
        pass


def outbox_of_stream(messages: DataFrame, days: int | None = MEMORY_DAYS) -> DataFrame:
    """A stream of what devices' outboxes are asked (MESSAGES) -> what each poll tells (SENT)."""
    return messages.where("device is not null").groupBy("device").transformWithStateInPandas(statefulProcessor=Outbox(days), outputStructType=SENT, outputMode="Append", timeMode="ProcessingTime" if days else "None")


def outbox_of_log(messages: DataFrame) -> DataFrame:
    """The same over a whole log, in order of time; a device's rows are walked as they come."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, acked = None, {}, -1
        for pdf in frames:
            clean, out = pdf.astype(object).where(pdf.notna(), None), []
            for device, at, kind, seq, body, expires in clean[["device", "at", "kind", "seq", "body", "expires"]].itertuples(index=False, name=None):
                if device != now:
                    now, held, acked = device, {}, -1
                acked, told = outbox_step(held, acked, at, kind, None if seq is None else int(seq), body, expires)
                out += [(device, at, *t) for t in told]
            yield pd.DataFrame(out, columns=["device", "at", "seq", "body"]).astype({"at": "datetime64[us]"})

    rows = messages.where("device is not null").repartition("device").sortWithinPartitions("device", "at", "kind", "seq")
    return rows.mapInPandas(walk, SENT)

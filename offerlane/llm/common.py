"""What the operators of this package share: shared folders, code shipping and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python code holds as words or arrays at a time.
CHUNK_BYTES = 1 << 20
#: How many keys can count as hot in look_up, whatever the size of the rows.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_offerlane_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="offerlane-"), "offerlane_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    sc._offerlane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local session (tests, one machine) gets one
    of its own; on a cluster that would be another folder on each machine, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="offerlane-shared-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def look_up(rows: DataFrame, found: DataFrame, key: str, total: int, how: str = "inner", bytes_of: Column | None = None, most: int = 0) -> DataFrame:
    """rows and the other columns of found(key, n, ...), whose n is at least the number of rows under the key.

    total bounds the sum of n. Keys with more than total / HOT_KEYS rows (100 at least) are fewer than HOT_KEYS, so they
    are broadcast and their rows stay where they lie; only the rows of other keys are shuffled. Where found holds values
    without a bound, bytes_of says how long they are: of the hot keys, only the hottest are then broadcast, as long as
    they have `most` bytes together. Rows whose key isn't in found are dropped, or kept with nulls if how is "left".
    """
    over, values = max(100, total // HOT_KEYS), [c for c in found.columns if c != key]
    if bytes_of is not None:
        while (found.where(F.col("n") > over).agg(F.sum(bytes_of + 64).alias("b")).first()["b"] or 0) > most:
            over *= 4
    hot = found.where(F.col("n") > over).select(key, F.struct(*values).alias("hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    here = marked.where("hot is not null").select(*rows.columns, *(F.col(f"hot.{c}").alias(c) for c in values))
    there = marked.where("hot is null").select(*rows.columns).join(found.where(F.col("n") <= over), key, how)
    return here.unionByName(there.select(*rows.columns, *values))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one value, so that no name of theirs meets another."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def row_hash(row: Column) -> Column:
    """Orders rows of any types, maps too, the same way in every run."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def one_row(docs: DataFrame, mark, kept: DataFrame) -> DataFrame:
    """Exactly one row of docs, with all its columns, whatever their names and types, for each mark of kept(mark, n), whose n
    is at least the number of docs' rows that have it. Of several rows the one with the least hash of all columns stays.
    Marks may hold nulls: they are told by hash."""
    found = checkpointed(kept.select(row_hash(F.struct("mark")).alias("mark"), "n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = look_up(docs.select(row_hash(F.struct(mark.alias("mark"))).alias("mark"), packed(docs).alias("row")), found, "mark", total)
    several = rows.where("n > 1").groupBy("mark").agg(F.min_by("row", row_hash(F.col("row"))).alias("row"))
    return rows.where("n = 1").select("row.*").unionByName(several.select("row.*"))


def fold(col_id: str, parts: int):
    """crc32 of the id as text, modulo parts: the folds that the contracts name. Null for a null id."""
    return F.crc32(F.col(col_id).cast("string").cast("binary")) % parts


def texts_of(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b or b"" for b in col.cast(pa.large_binary()).to_pylist()]


def chunks(values: list, size=len):
    """Slices (from, to) of values of about CHUNK_BYTES each; a longer value is a slice of its own."""
    at, held = 0, 0
    for i, v in enumerate(values):
        n = size(v)
        if i > at and held + n > CHUNK_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(values):
        yield at, len(values)


_ODD = 0x9E3779B97F4A7C15
_UNDO = pow(_ODD, -1, 1 << 64)


def runs_of(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes that aren't blank begin and end."""
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edge[::2], edge[1::2]


def run_hashes(body: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, by prefix sums of a polynomial modulo 2^64: equal runs have equal hashes wherever they stand."""
    power = np.cumprod(np.full(len(body), _ODD, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((body + np.uint64(1)) * power))
    h = (sums[ends] - sums[begins]) * np.cumprod(np.full(len(body), _UNDO, np.uint64))[begins]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the offset at which each part ends."""
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)

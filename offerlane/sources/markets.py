"""Markets as sources: what each can filter itself, and one question put to several."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.functions import money
from offerlane.sources.tables import CURRENCIES, listings


@dataclass(frozen=True)
class Market:
    name: str
    currency: str
    filters_price: bool = True
    filters_words: bool = True


@dataclass(frozen=True)
class Question:
    words: str
    least_eur: int | None = None
    most_eur: int | None = None


MARKETS = {name: Market(name, currency, filters_price=currency == "EUR") for name, currency in CURRENCIES.items()}


def scan(spark: SparkSession, sf_dir: str, market: Market, asked: Question) -> DataFrame:
    """A market's offers for sale, filtered by what it can filter: the rest comes back unfiltered."""
    rows = listings(spark, sf_dir).where((F.col("platform") == market.name) & ~F.col("sold"))
    rows = rows.withColumn("cents", money.convert(F.col("price_cents"), F.col("currency")))
    if market.filters_words:
        rows = rows.where(F.contains(F.lower("title"), F.lit(asked.words.lower())))
    return _in_band(rows, asked) if market.filters_price else rows


def _in_band(rows: DataFrame, asked: Question) -> DataFrame:
    if asked.least_eur is not None:
        rows = rows.where(F.col("cents") >= asked.least_eur * 100)
    return rows.where(F.col("cents") <= asked.most_eur * 100) if asked.most_eur is not None else rows


def search(spark: SparkSession, sf_dir: str, names: list[str], asked: Question) -> DataFrame:
    """The answers of several markets as one; an unknown market is an error."""
    unknown = set(names) - set(MARKETS)
    if unknown:
        raise KeyError(f"no such market: {', '.join(sorted(unknown))}")
    answers = [_in_band(scan(spark, sf_dir, MARKETS[n], asked), asked).where(F.contains(F.lower("title"), F.lit(asked.words.lower()))) for n in names]
    return reduce(DataFrame.unionByName, answers)


def read_archive(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An archive of a JSON file for each row."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file whose header is skipped; rows that don't read as the schema says are left out."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED")


def replace_store(df: DataFrame, path: str) -> None:
    """Write a store as a whole: what is there stays until the new one is complete.

    The new store is written beside the old one, and only then takes its name; the old one is renamed first and deleted last.
    A failed write leaves the old store as it is, and the part that was written under a name of its own. Should the driver be
    lost between the two renames, the old store is whole under `<path>.old-...`; read_whole_store finds it there."""
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, mark = at.getFileSystem(hadoop), uuid.uuid4().hex
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{name}-{mark}") for name in ("new", "old"))
    df.write.json(new.toString())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} could not be renamed")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{new.toString()} could not be renamed")
    if had:
        fs.delete(old, True)


def read_whole_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store as replace_store left it, even if it was stopped between its renames."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        left = sorted(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-*")), key=lambda f: f.getModificationTime())
        if left:
            fs.rename(left[-1].getPath(), at)
    return spark.read.schema(schema).json(path)

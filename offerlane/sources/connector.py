"""A market as a source of Spark's own: spark.read.format("market_offers"), with the filters the market can apply itself.

What is asked of the market goes to it as options of the read. Spark 4.1 can push filters to a Python source, but keeps one
state for all uses of a loaded DataFrame: after `df.where(...)` ran, `df.count()` counted the filtered rows only. A question
with a load and options of its own can't be mixed up with another.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a market may filter itself.
ABLE = ("market", "price", "words")

#: A file up to this size is one partition; a larger one is dealt by its row groups.
SPLIT_BYTES = 256 << 20


def market_source() -> type:
    """The data source. The class is made here so that executors get it by value, without this package on their path."""
    from pyspark.sql import datasource as api

    class MarketReader(api.DataSourceReader):
        def __init__(self, path: str, asked: dict):
            self.path, self.asked = path, asked

        def _files(self):
            from pyarrow import dataset, fs

            system, at = fs.FileSystem.from_uri(self.path)
            return system, dataset.dataset(at, format="parquet", filesystem=system)

        def partitions(self):
            system, files = self._files()
            parts = []
            for piece in files.get_fragments():
                large = system.get_file_info(piece.path).size > SPLIT
                parts += [api.InputPartition((piece.path, group)) for group in ([g.id for g in piece.row_groups] if large else [None])]
            return parts

        def _wanted(self):
            """What was asked, as one expression over the file's columns."""
            from functools import reduce

            from pyarrow import compute as pc
            from pyarrow import dataset

            raw = dataset.field("p_retailprice")
            cents, parts = pc.round(raw * 100, round_mode="half_towards_infinity"), []
            if (names := self.asked.get("markets")) is not None:
                parts.append(dataset.field("p_brand").isin(pa_strings(names)))
            if (words := self.asked.get("words")) is not None:
                parts.append(pc.match_substring(dataset.field("p_name"), words))
            # beside each exact bound a looser one on the stored column, which the files' statistics can use
            if (least := self.asked.get("least")) is not None:
                parts += [cents >= least, raw >= (least - 1) / 100]
            if (most := self.asked.get("most")) is not None:
                parts += [cents <= most, raw <= (most + 1) / 100]
            return reduce(lambda a, b: a & b, parts) if parts else None

        def read(self, partition):
            from pyarrow import compute as pc
            from pyarrow import dataset
            import pyarrow as pa

            at, group = partition.value
            system, _ = self._files()
            piece = dataset.ParquetFileFormat().make_fragment(at, filesystem=system, row_groups=None if group is None else [group])
            names = ["p_brand", "p_partkey", "p_name", "p_retailprice"]
            for batch in piece.to_batches(columns=names, filter=self._wanted(), batch_size=8192):
                cents = pc.round(pc.multiply(batch["p_retailprice"], 100.0), round_mode="half_towards_infinity").cast(pa.int64())
                columns = [batch["p_brand"].cast(pa.string()), batch["p_partkey"].cast(pa.int64()), batch["p_name"].cast(pa.string()), cents]
                yield pa.RecordBatch.from_arrays(columns, names=["market", "offer", "title", "cents"])

    class MarketOffers(api.DataSource):
        @classmethod
        def name(cls):
            return "market_offers"

        def schema(self):
            return "market string, offer long, title string, cents long"

        def reader(self, schema):
            return MarketReader(self.options["path"], json.loads(self.options.get("asked", "{}")))

    def pa_strings(names):
        import pyarrow as pa

        return pa.array(names, pa.string())

    SPLIT = SPLIT_BYTES
    return MarketOffers


@dataclass(frozen=True)
class Asked:
    """What is asked of markets; None asks for all. A market or price that isn't stated doesn't fit what asks for one."""

    markets: tuple[str, ...] | None = None
    least: int | None = None
    most: int | None = None
    words: str | None = None


def market_offers(spark: SparkSession, path: str, asked: Asked = Asked(), able: tuple[str, ...] = ABLE) -> DataFrame:
    """(market, offer, title, cents) of what the catalogue at path, a file, folder or address of Parquet files, has for the
    question. What the market is able to filter is asked of it, and goes from there to the files' statistics; Spark filters
    the rest after. An ability that isn't known is an error."""
    if unknown := sorted(set(able) - set(ABLE)):
        raise ValueError(f"no such filter: {', '.join(unknown)}")
    wanted = {
        "markets": ("market", F.col("market").isin(*(asked.markets or ()))),
        "least": ("price", F.col("cents") >= F.lit(asked.least)),
        "most": ("price", F.col("cents") <= F.lit(asked.most)),
        "words": ("words", F.contains("title", F.lit(asked.words))),
    }
    stated = {name: value for name, value in vars(asked).items() if value is not None}
    pushed = {name: value for name, value in stated.items() if wanted[name][0] in able}
    spark.dataSource.register(market_source())
    rows = spark.read.format("market_offers").option("asked", json.dumps(pushed)).load(path)
    for name in sorted(stated.keys() - pushed.keys()):
        rows = rows.where(wanted[name][1])
    return rows

"""Names of a dictionary in whole texts: the longest ones, where names lie inside others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dictionary with up to this many characters goes to every task as an automaton; a larger one is joined.
INLINE_CHARS = 4 << 20


def words_of(text: str) -> Column:
    """The words of a text: runs of letters and digits, lower-cased; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def longest_names(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, inline_chars: int = INLINE_CHARS) -> DataFrame:
    """(key, name, first_word, n_words): where a name's words stand consecutively in a text, from first_word on (from 0), unless that
    place lies within a longer name's. Names that only overlap both stay. Names with equal words are one, without words
    none. key tells texts apart.

    A dictionary of up to inline_chars characters (counted first) is an automaton that reads each text once, and nothing is
    shuffled. A larger one is joined with the texts' runs of as many words as its names have: each run moves once."""
    known = names.select(words_of(name).alias("w")).where(F.size("w") > 0).select(F.array_join("w", " ").alias("name"), F.size("w").alias("n_words")).distinct()
    lengths = known.groupBy("n_words").agg(F.sum(F.length("name") + 2).alias("chars")).collect()  # a row for each length of names
    if sum(r["chars"] for r in lengths) <= inline_chars:
        return _by_automaton(texts, key, text, [r["name"] for r in known.select("name").collect()])  # within inline_chars
    return _by_join(texts, key, text, known, sorted(r["n_words"] for r in lengths))


def _by_automaton(texts: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(names)

    def found(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for n in sent.value:
            automaton.add_word(f" {n} ", n)
        if sent.value:
            automaton.make_automaton()
        for batch in batches:
            rows, said, at, sizes = [], [], [], []
            for i, padded in enumerate(batch.column(1).to_pylist() if sent.value else []):
                spans = sorted((end - len(n) - 1, -end, n) for end, n in automaton.iter(padded))
                last, place, seen = -1, 0, 0
                for start, end, n in spans:
                    if -end > last:  # else within an earlier one's span
                        last = -end
                        place, seen = place + padded.count(" ", seen, start), start
                        rows.append(i)
                        said.append(n)
                        at.append(place)
                        sizes.append(n.count(" ") + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string()), pa.array(at, pa.int64()), pa.array(sizes, pa.int32())], names=[key, "name", "first_word", "n_words"])

    padded = texts.select(key, F.concat(F.lit(" "), F.array_join(words_of(text), " "), F.lit(" ")).alias("padded"))
    return padded.mapInArrow(found, f"`{key}` {dict(texts.dtypes)[key]}, name string, first_word long, n_words int")


def _by_join(texts: DataFrame, key: str, text: str, known: DataFrame, lengths: list[int]) -> DataFrame:
    words = texts.select(key, words_of(text).alias("w"))
    counts = F.explode(F.array(*(F.lit(n) for n in lengths)))
    long_enough = words.select(key, "w", counts.alias("n_words")).where(F.size("w") >= F.col("n_words"))
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n_words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n_words")), " ")))
    met = long_enough.select(key, "n_words", places.alias("first_word", "name")).join(known, ["name", "n_words"])
    end = F.col("first_word") + F.col("n_words")
    before = F.max(end).over(Window.partitionBy(key).orderBy("first_word", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("_before", before).where(F.col("_before").isNull() | (end > F.col("_before"))).select(key, "name", F.col("first_word").cast("long").alias("first_word"), "n_words")

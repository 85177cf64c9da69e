"""What a code is called: the words, and pairs of words, that stand around it in several places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_contexts(df: DataFrame, text: str, reach: int = 5, least_length: int = 3) -> DataFrame:
    """(code, words): the distinct surroundings of each code in whole texts, `reach` words to each side. A code is a word of
    least_length characters or more with a digit in it; a text's words are runs of letters and digits, lower-cased, and a
    null text has none. Only surroundings leave a text's row, not the text, and copies of them are dropped before the shuffle."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = df.select(words.alias("w")).where(F.size("w") > 0)
    codes = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.rlike(F.element_at("w", i), F.lit("[0-9]")) & (F.length(F.element_at("w", i)) >= least_length))
    start = lambda i: F.greatest(i - reach, F.lit(1))
    around = lambda i: F.concat(F.slice("w", start(i), i - start(i)), F.slice("w", i + 1, reach))
    each = rows.select(F.explode(F.transform(codes, lambda i: F.struct(F.element_at("w", i).alias("code"), around(i).alias("words")))).alias("c"))
    return each.select("c.*").distinct()


def _naming(contexts: DataFrame, least_letters: int) -> DataFrame:
    """A row for each surrounding and distinct word of letters alone in it."""
    named = F.filter(F.array_distinct("words"), lambda w: F.rlike(w, F.lit(rf"^\p{{L}}{{{least_letters},}}$")))
    return contexts.select("code", "words", F.explode(named).alias("word"))


def code_words(contexts: DataFrame, least: int = 3, least_letters: int = 4) -> DataFrame:
    """(code, word, n): words of letters that stand in `least` of a code's surroundings or more."""
    return _naming(contexts, least_letters).groupBy("code", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def code_pairs(contexts: DataFrame, least: int = 3, least_pairs: int = 2, least_letters: int = 4) -> DataFrame:
    """(code, a, b, n): pairs of a code's frequent words that stand together in least_pairs of its surroundings, a < b.

    Words that aren't frequent go before any pair is made. A surrounding has 2 x reach words at most, so it gives a bounded
    number of pairs, and no code's surroundings are ever gathered: a hot code's rows are spread by word, then by surrounding."""
    frequent = code_words(contexts, least, least_letters).select("code", "word")
    kept = _naming(contexts, least_letters).join(frequent, ["code", "word"])
    sets = kept.groupBy("code", "words").agg(F.array_sort(F.collect_list("word")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("code", F.explode(pairs).alias("p")).groupBy("code", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pairs)

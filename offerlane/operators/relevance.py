"""Which offers answer a query: token scores with vetoes, and a reason for each that doesn't."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions import text
from offerlane.operators.aggregates import upper_median

#: Words of ads that ask or rent out, prepositions before what an accessory is for, accessory nouns.
WANTED = ["suche", "gesucht", "wanted", "ankauf", "stellenangebot", "cerco", "cherche", "busco"]
RENTAL = ["vermiete", "mieten", "verleih", "rental", "noleggio", "location"]
FOR = ["für", "fuer", "for", "per", "pour", "para", "voor"]
ACCESSORIES = ["case", "cover", "cable", "charger", "strap", "holder", "adapter", "hülle", "kabel", "halter", "ring"]
SCORE_FLOOR = 0.76
TOKEN_PRICE_CENTS, TOKEN_MEDIAN_CENTS = 100, 2000
SANE_CENTS = 200_000_000_000


@dataclass(frozen=True)
class Query:
    words: str
    blocked: list[str] = field(default_factory=list)


def token_score(words: Column, stated: Column, query: str) -> Column:
    """The share of the query's words that stand in a title, whole or glued; 0 where a stated size is another one. words
    and stated: the title's tokens and sizes."""
    wanted = [w for w in query.lower().split() if w]
    forms = F.concat(words, text.ngrams(words, 2))
    matched = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), forms)) / F.lit(float(max(1, len(set(wanted)))))
    asked = text.sizes_gb(F.lit(query))
    other = (F.size(asked) > 0) & (F.size(stated) > 0) & ~F.arrays_overlap(asked, stated)
    return F.when(other, 0.0).otherwise(matched)


def accessory_for(title: Column, query: str) -> Column:
    """An accessory noun, a preposition, and then the thing asked for."""
    first = query.lower().split()[0]
    return F.rlike(F.lower(title), F.lit(f"(^|[^\\p{{L}}])({'|'.join(ACCESSORIES)})s? .*({'|'.join(FOR)}) .*{first}"))


def of_title(title: Column, query: Query) -> Column:
    """What hangs on the title alone: (relevance, reason), reason null where no word rules the title out."""
    said = F.array(F.struct(text.tokens(title).alias("words"), text.sizes_gb(title).alias("sizes"), title.alias("title")))
    return F.get(F.transform(said, lambda s: _of_title(s["words"], s["sizes"], s["title"], query)), F.lit(0))


def _of_title(words: Column, sizes: Column, title: Column, query: Query) -> Column:
    asks = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws))) & F.lit(not set(ws) & set(query.words.lower().split()))
    reason = (
        F.when(asks(WANTED), "wanted ad")
        .when(asks(RENTAL), "rental")
        .when(accessory_for(title, query.words), "accessory")
        .when(text.says_blocked(words, query.blocked) if query.blocked else F.lit(False), "blocked word")
    )
    return F.struct(token_score(words, sizes, query.words).alias("relevance"), reason.alias("reason"))


def relevance_reason(df: DataFrame, query: Query, keys: list[str]) -> DataFrame:
    """df with relevance and drop_reason (null: it stays); every row stays in the table. The price rule looks at the
    upper median of each answer (keys). What hangs on the title alone is worked out once for each distinct title, or
    taken from a column _of_title (of_title), where whoever reads the rows has worked it out."""
    middle = upper_median(df.where(F.col("price_cents").between(0, SANE_CENTS)), "price_cents", keys, "_middle").drop("n")
    if "_of_title" not in df.columns:
        df = df.join(df.select("title").distinct().withColumn("_of_title", of_title(F.col("title"), query)), "title", "left")
    rows = df.withColumn("relevance", F.col("_of_title.relevance")).withColumn("_of_title", F.col("_of_title.reason")).join(middle, keys, "left")
    several = F.lit(len(set(query.words.split())) > 1)
    reason = (
        F.when(~F.col("price_cents").between(0, SANE_CENTS), "price")
        .when(F.col("price_cents").between(1, TOKEN_PRICE_CENTS) & (F.col("_middle") >= TOKEN_MEDIAN_CENTS), "token price")
        .when(F.col("_of_title").isNotNull(), F.col("_of_title"))
        .when(several & (F.col("relevance") < SCORE_FLOOR), "off target")
        .when(~several & (F.col("relevance") <= 0), "off target")
    )
    return rows.withColumn("drop_reason", reason).drop("_middle", "_of_title")


#: A model code of joined parts or one long word, and specifications written the same way.
MODEL_CODE, SPEC_CODE = "[a-z0-9]+(?:-[a-z0-9]+)+|[a-z0-9]{6,}", "^(?:ddr[0-9]|pc[0-9]|usb[0-9]|[0-9]+(?:gb|tb|mb|w|mm|kg)$)"


def is_the_part(title: Column, number: str) -> Column:
    """Whether a title has a part number, or the last seven of its eleven digits."""
    compact = F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
    forms = [number] + ([number[-7:]] if len(number) == 11 and number.isdigit() else [])
    found = F.lit(False)
    for f in forms:
        found = found | F.contains(compact, F.lit(f))
    return found


def model_codes(title: Column) -> Column:
    codes = F.transform(F.regexp_extract_all(F.lower(title), F.lit(MODEL_CODE), F.lit(0)), lambda c: F.replace(c, F.lit("-"), F.lit("")))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.filter(codes, lambda c: (F.length(c) >= 5) & (digits(c) >= 2) & (digits(c) < F.length(c)) & ~F.rlike(c, F.lit(SPEC_CODE)))


def names_another_model(title: Column, code: str) -> Column:
    """Whether a title prints a model code that is neither the one asked for nor a shorter or longer form of it."""
    asked = F.lit(code)
    return F.exists(model_codes(title), lambda c: ~F.startswith(asked, c) & ~F.contains(c, asked))

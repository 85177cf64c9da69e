"""Words of searches and titles: one spelling for each, heads of compounds, vetoes."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are spelled out, and letters without their marks.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
MARKED, PLAIN = "éèêëàâáçôóùûúîïí", "eeeeaaacoouuuiii"
FOLDED = str.maketrans({**SPELLED, **dict(zip(MARKED, PLAIN))})
#: Units after a number, names in two words, and words that stand right after a number, glued to it or not.
UNITS = {"gigabyte": "gb", "gigabytes": "gb", "giga": "gb", "gigas": "gb", "go": "gb", "terabyte": "tb", "terabytes": "tb"}
NAMES = {"i phone": "iphone", "i phon": "iphone", "i pfon": "iphone", "i fon": "iphone", "i pad": "ipad", "iphon": "iphone", "ipfon": "iphone", "ifon": "iphone"}
GLUED = ["fe", "ti", "pro"]
DIGITS = tuple("0123456789")
#: Words of a batch of texts that are kept once they were cut.
KNOWN_WORDS = 100_000
#: What wears out and is bought for a machine; what holds a part; what comes along with a thing.
CONSUMABLES = ["schleifpapier", "staubbeutel", "filterbeutel", "tintenpatrone", "tonerkartusche", "sägeblatt", "ersatzakku"]
HOSTS = ["laptop", "notebook", "desktop", "server", "nas", "konsole"]
COMES_WITH = ["mit", "inkl", "with", "und"]


def _number_apart(word: str) -> list[str]:
    """What a word of a number and letters is: both apart where the letters are a unit or go after numbers, else itself."""
    rest = word.lstrip("0123456789")
    return [word[: -len(rest)], rest] if rest != word and (rest in UNITS or rest in GLUED) else [word]


def _simple_words(word: str) -> list[str]:
    """The words of what stands between blanks: one decimal stays one word, a plus after a digit is a word."""
    bare = word.strip(".,")
    if re.fullmatch("[0-9][.,][0-9]", bare):
        return [f"{bare[0]}p{bare[2]}"]
    words = re.split(" +", bare.replace("+", " + ").replace(".", " ").replace(",", " "))
    told = ["plus" if w == "+" and before[-1:] in DIGITS else w for before, w in zip(["", *words], words)]
    return [w for w in told if w not in ("", "+")]


def _normalised(text: str, known: dict[str, list[str]]) -> str:
    """text: in lower case; known: the simple words of words that were read before."""
    words = []
    for word in re.findall("[a-z0-9.,+]+", text if text.isascii() else text.translate(FOLDED)):
        if word not in known:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = [x for w in _simple_words(word) for x in _number_apart(w)]
        words += known[word]
    words = [UNITS[w] if w in UNITS and re.fullmatch("[0-9p]*[0-9]", before) else w for before, w in zip(["", *words], words)]
    pairs = [NAMES.get(f"{w} {after}") if w == "i" else None for w, after in zip(words, [*words[1:], ""])]
    # the second word of a pair has gone into the first
    return " ".join(pair or NAMES.get(w, w) for taken, pair, w in zip([None, *pairs], pairs, words) if not taken)


def normalise(text: Column) -> Column:
    """Lower-cased words of letters and digits, in one spelling for names, units, marks and decimals. Text is cut into
    words, words are cut into simpler ones, and each is looked up in the tables, by itself and with its neighbour."""

    def told(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        return pd.Series([None if t is None else _normalised(t, known) for t in texts], dtype=object)

    return F.pandas_udf(told, "string")(F.lower(text))


def _stands(padded: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(padded, F.lit(f" {w} ")) for w in words])


def is_consumable(normalised: Column, query: str) -> Column:
    """Whether a text is about what wears out, and neither the search is nor the thing merely comes with it."""
    if any(c in query.lower() for c in CONSUMABLES):
        return F.lit(False)
    padded = F.concat(F.lit(" "), normalised, F.lit(" "))
    words = [w.replace("ä", "ae") for w in CONSUMABLES]
    along = reduce(or_, [F.contains(padded, F.lit(f" {c} {w} ")) for c in COMES_WITH for w in words])
    return _stands(padded, words) & ~along


def is_built_in(normalised: Column, query: str) -> Column:
    """Whether a machine is named before all of the words asked for: they say what it holds."""
    if any(h in query.lower() for h in HOSTS):
        return F.lit(False)
    padded = F.concat(F.lit(" "), normalised, F.lit(" "))
    host = reduce(F.least, [F.when(F.instr(padded, f" {h} ") > 0, F.instr(padded, f" {h} ")).otherwise(1 << 30) for h in HOSTS])
    asked = [F.instr(padded, f" {w} ") for w in query.lower().split()]
    return reduce(lambda a, b: a & b, [(p > 0) & (host < p) for p in asked])

"""What a text says of its sale. Texts are lower-cased."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, by language: what a seller says has become of the thing, and the words just before it that say it has happened.
GONE = {"de": ["verkauft", "reserviert", "vergeben", "weg"], "en": ["sold"], "fr": ["vendu"], "nl": ["verkocht"]}
HAPPENED = {"de": ["bereits", "schon", "ist", "wurde", "leider"], "en": ["already", "been", "is"], "fr": ["déjà"], "nl": ["al"]}
#: What is no more, after the words that say so.
NO_MORE = {"nicht mehr": ["verfügbar", "verfugbar", "zu haben", "da"], "no longer": ["available"], "nie meer": ["beschikbaar"]}
#: Words of a title that say the same without more.
TITLE_GONE = ["verkauft", "reserviert", "vergeben", "verhandelt", "verkocht", "sold", "reserved", "vendu", "réservé", "reserve"]
#: Whole phrases.
DEFECTIVE = ["für bastler", "als defekt", "defekt verkauft", "for parts", "for spares", "not working", "non funzionante", "hors service", "werkt niet"]


def _any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _in_pairs(words: Column) -> Column:
    """Each word with the one before it, the first with none."""
    return F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda before, w: F.concat(before, F.lit(" "), w))


def text_says_sold(text: Column) -> Column:
    """Whether a description says that the thing is gone: a word for it right after one that says it has happened (so "will
    be sold" and a count of sales, "500 sold", say nothing), or that it is no more."""
    words = words_of(text)
    happened = [f"{h} {g}" for language in GONE for h in HAPPENED[language] for g in GONE[language]]
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    gone = [f" {lead} {what} " for lead, all_ in NO_MORE.items() for what in all_]
    return F.coalesce(F.arrays_overlap(_in_pairs(words), F.array(*map(F.lit, happened))), F.lit(False)) | _any_of(spaced, gone)


def title_says_sold(title: Column) -> Column:
    """Whether a title has a word for gone that doesn't follow a number: "12 verkauft" counts sales, "Pixel 9 (verkauft)" not."""
    # a sign between two words is a word, so that it parts them
    words = F.filter(F.split(F.regexp_replace(F.lower(title), "[^\\p{L}\\p{N}\\s+.,]", " | "), "[^\\p{L}\\p{N}|]+"), lambda w: w != "")
    after = F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda before, w: F.when(~F.rlike(before, F.lit("^[0-9]+$")), w))
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.coalesce(F.arrays_overlap(F.filter(after, lambda w: w.isNotNull()), F.array(*map(F.lit, TITLE_GONE))), F.lit(False)) | _any_of(spaced, [f" {lead} {what} " for lead, all_ in NO_MORE.items() for what in all_])


def says_defective(text: Column) -> Column:
    return _any_of(text, DEFECTIVE)


def pickup_only(text: Column) -> Column:
    return F.rlike(text, F.lit("nur (?:an )?(?:selbst)?abhol|nur zur abholung|keine?n? versand"))


def shipping_eur(free: Column, pickup: Column, cents: Column, currency: Column) -> Column:
    return F.when(free | pickup, 0.0).when(cents.isNotNull() & (currency == "EUR"), cents / 100.0)

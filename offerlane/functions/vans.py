"""Sizes of vans, as sets of what they may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and the sizes they leave open. Codes such as L3H2 name one.
LENGTHS = {"kurz": [1, 2], "mittellang": [2, 3], "lang": [3, 4], "maxi": [3, 4, 5]}
HEIGHTS = {"flachdach": [1], "normaldach": [1, 2], "hochdach": [2, 3], "superhochdach": [3, 4]}


def narrowed(signs: Column, all_: list[int]) -> Column:
    """What a row of sets have in common, taken one after the other; a set that leaves nothing is passed over."""
    start = F.array(*(F.lit(n) for n in all_))
    both = lambda a, s: F.when(F.size(F.array_intersect(a, s)) > 0, F.array_intersect(a, s)).otherwise(a)
    return F.array_sort(F.aggregate(signs, start, both))


def _signs(text: Column, code: str, most: int, words: dict[str, list[int]]) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-zäöü0-9]+", " "), F.lit(" "))
    coded = F.regexp_extract(padded, f" (?:[a-z][0-9])?{code}([1-{most}])(?:[a-z][0-9])? ", 1)
    said = [F.when(F.contains(padded, F.lit(f" {w} ")), F.array(*(F.lit(n) for n in sizes))) for w, sizes in words.items()]
    return F.array_compact(F.array(F.when(coded != "", F.array(coded.cast("int"))), *said))


def lengths(text: Column) -> Column:
    return narrowed(_signs(text, "l", 5, LENGTHS), [1, 2, 3, 4, 5])


def heights(text: Column) -> Column:
    return narrowed(_signs(text, "h", 4, HEIGHTS), [1, 2, 3, 4])

"""What a drive's health screen says, from its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An attribute's number on the screen and words of its name; how many moved sectors are many.
ATTRIBUTES = {"reallocated": ("05", "reallocated"), "pending": ("c5", "pending"), "uncorrectable": ("c6", "uncorrectable"), "hours": ("09", "power[- ]on")}
MANY_REALLOCATED = 100


def count_of(screen: Column, attribute: str) -> Column:
    """The last number of the line that starts with an attribute's number and has its name; null if it isn't read."""
    number, name = ATTRIBUTES[attribute]
    digits = F.regexp_extract(F.lower(screen), f"(?:^|\\n) *{number} [^\\n]*{name}[^\\n]*?([0-9]+) *(?:\\n|$)", 1)
    return F.when(digits != "", digits.try_cast("long"))


def verdict(reallocated: Column, pending: Column, uncorrectable: Column, solid_state: Column) -> Column:
    """Failing where a bad count was seen, worn where a few sectors were moved, clean where every count was read and is
    zero (a solid-state drive has no pending one), else unreadable."""
    some = lambda c, n: F.coalesce(c > n, F.lit(False))
    none = lambda c: F.coalesce(c == 0, F.lit(False))
    return (
        F.when(some(pending, 0) | some(uncorrectable, 0) | some(reallocated, MANY_REALLOCATED), "FAILING")
        .when(some(reallocated, 0), "WORN")
        .when(none(reallocated) & (none(pending) | (pending.isNull() & solid_state)) & none(uncorrectable), "CLEAN")
        .otherwise("UNREADABLE")
    )

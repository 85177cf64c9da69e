"""Predicates of searches and alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def may_be(low: Column, high: Column, wanted: list[int]) -> Column:
    """Whether one of the whole numbers from low to high is wanted; an unstated low stays, an unstated high is the low."""
    inside = [F.lit(w).between(low, F.coalesce(high, low)) for w in wanted]
    return low.isNull() | reduce(or_, inside, F.lit(False))


def holds_all(text: Column, words: str) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return reduce(and_, [F.contains(t, F.lit(w)) for w in words.lower().split()], F.lit(True))


def words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands there as whole words."""
    padded = F.concat(F.lit(" "), words_only(text), F.lit(" "))
    return reduce(or_, [F.contains(padded, F.lit(f" {p} ")) for p in phrases], F.lit(False))


def chosen(choices: dict[str, list[str]]) -> Column:
    """Rows that one of the choices names; all where nothing is chosen."""
    made = [F.col(c).isin(v) for c, v in choices.items() if v]
    return reduce(or_, made) if made else F.lit(True)


@dataclass(frozen=True)
class AlertRule:
    least_eur: int | None = None
    most_eur: int | None = None
    condition: str | None = None  # "new", "used" or any
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()


def matches_rule(rule: AlertRule, cents: str = "cents", condition: str = "condition", title: str = "title") -> Column:
    """Whether an offer is one the alert is about. A price that isn't there is in no band, a broken thing never matches,
    and a condition that isn't stated is used."""
    c, t = F.col(condition), F.lower(F.col(title))
    parts = [~c.eqNullSafe("PARTS_ONLY")]
    if rule.least_eur is not None:
        parts.append(F.coalesce(F.col(cents) >= rule.least_eur * 100, F.lit(False)))
    if rule.most_eur is not None:
        parts.append(F.coalesce(F.col(cents) <= rule.most_eur * 100, F.lit(False)))
    if rule.condition:
        parts.append(c.eqNullSafe("NEW") if rule.condition == "new" else ~c.eqNullSafe("NEW"))
    if rule.any_of:
        parts.append(reduce(or_, [F.contains(t, F.lit(w)) for w in rule.any_of]))
    parts += [~F.contains(t, F.lit(w)) for w in rule.none_of]
    return reduce(and_, parts)

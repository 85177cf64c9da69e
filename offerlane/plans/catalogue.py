"""All queries of the library, by name."""

from offerlane.plans import answers, drives, lookups, models, more, offers, others, repairs, sightings, terms, vehicles  # noqa: F401
from offerlane.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

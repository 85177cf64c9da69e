"""What texts say of storage drives: model numbers and what they encode, interface, recording, hours, lots, unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How makers number their drives, and the words for interfaces, recording and hours.
SEAGATE, WD, TOSHIBA = "st([0-9]{3,5})([a-z]{2}[0-9]{3,4}[a-z]?)", "wd([0-9]{2,4})([a-z]{4})", "(m[gn][0-9]{2})[a-z]{3}([0-9]{2,3})t"
INTERFACES = {"NVME": "nvme|pcie|m[.]2", "SAS": "sas", "SATA": "sata"}
RECORDINGS = {"CMR": "cmr|pmr", "SMR": "smr"}
HOURS = "([0-9]{1,3}(?:[.][0-9]{3})+|[0-9]{2,6}) ?(?:h|std|stunden|betriebsstunden)(?:$|[^a-z0-9])"
HOURS_BAND = (100, 300_000)
UNIT = "([0-9]{1,4}(?:[.,][0-9]{1,2})?) ?(?:€|eur|euro) ?(?:/|pro|je) ?(?:stück|platte|hdd|festplatte)"
LOT = "([0-9]{1,2}) ?[x×] ?(?:[0-9]+ ?tb|seagate|wd|toshiba|hdd|festplatte)"


def _word(words: str) -> str:
    return f"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group as a whole number; null where nothing matches."""
    return F.regexp_extract(F.lower(text), pattern, group).try_cast("long")


def model_capacity_gb(text: Column) -> Column:
    """The GB that a model number encodes: Seagate's own count; WD's tenths of TB (two or three digits) or GB; Toshiba's TB."""
    seagate, wd, toshiba = _number(text, SEAGATE), _number(text, WD), _number(text, TOSHIBA, 2)
    long_wd = F.length(F.regexp_extract(F.lower(text), WD, 1)) == 4
    return F.coalesce(seagate, F.when(long_wd, F.floor(wd / 10)).otherwise(F.floor(wd / 10) * 1000), toshiba * 1000)


def model_family(text: Column) -> Column:
    """Drives that differ in capacity alone are one family."""
    low, part = F.lower(text), lambda p, g: F.nullif(F.upper(F.regexp_extract(F.lower(text), p, g)), F.lit(""))
    return F.coalesce(part(TOSHIBA, 1), F.concat(F.lit("Seagate "), part(SEAGATE, 2)), F.when(F.rlike(low, F.lit(WD)), F.concat(F.lit("WD "), part(WD, 2))))


def one_of(text: Column, kinds: dict[str, str]) -> Column:
    """The kind whose words a text has; null where it has those of none or of several."""
    said = F.array_compact(F.array(*(F.when(F.rlike(F.lower(text), F.lit(_word(p))), k) for k, p in kinds.items())))
    return F.when(F.size(said) == 1, F.get(said, F.lit(0)))


def hours(text: Column) -> Column:
    """The most hours a text states; small figures are delivery times."""
    said = F.transform(F.regexp_extract_all(F.lower(text), F.lit(HOURS), F.lit(1)), lambda s: F.replace(s, F.lit("."), F.lit("")).try_cast("long"))
    return F.array_max(F.filter(said, lambda h: h.between(*HOURS_BAND)))


def lot(title: Column) -> Column:
    n = _number(title, LOT)
    return F.when(n > 1, n)


def unit_cents(text: Column) -> Column:
    """What one drive costs, where a text states it."""
    euros = F.replace(F.regexp_extract(F.lower(text), UNIT, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.round(euros * 100).cast("long")


def cents_per_gb(cents: Column, sale_type: Column, capacity_gb: Column, pieces: Column, unit: Column) -> Column:
    """Null for auctions and rents, and where no capacity is known; a stated unit price comes before the lot's share."""
    one = F.coalesce(unit.cast("double"), cents / F.coalesce(pieces, F.lit(1)))
    open_price = ~F.coalesce(sale_type.isin("AUCTION", "RENT"), F.lit(False))
    return F.when(open_price & (capacity_gb > 0), F.round(one / capacity_gb * 1000) / 1000)

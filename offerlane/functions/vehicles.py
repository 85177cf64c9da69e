"""What texts say of vehicles, and what one costs to own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts state a mileage, a power, a first registration, an engine's size and a towbar; PS in a kW.
KM = "([0-9]{1,3}(?:[. ][0-9]{3})+|[0-9]{1,7}) ?km(?:$|[^a-z/])"
THOUSAND_KM = "(?:^|[^0-9.,])([0-9]{1,3}) ?(?:tkm|tsd[.]? ?km)(?:$|[^a-z])"
KW, PS = "(?:^|[^0-9.,])([0-9]{2,4}) ?kw(?:$|[^a-z])", "(?:^|[^0-9.,])([0-9]{2,4}) ?ps(?:$|[^a-z])"
INSPECTION = "(?:^|[^a-zäöü])(?:tüv|hu|au)[^a-z0-9][^0-9]{0,8}(?:[0-9]{2}/)?(?:19|20)[0-9]{2}"
LABELLED_YEAR = "(?:^|[^a-zäöü])(?:ez|erstzulassung|baujahr|bj[.]?)[ :]*(?:[0-9]{2}/)?((?:19|20)[0-9]{2})"
YEAR = "(?:^|[^0-9./])((?:19|20)[0-9]{2})(?:$|[^0-9€.])"
CCM, LITRES = "([0-9]{3,4}) ?(?:ccm|cm³)", "(?:^|[^0-9])([0-9])[.,]([0-9]) ?(?:liter|tdi|tsi|cdi|hdi)"
TOWBAR = "anhängerkupplung|ahk"
PS_OF_KW = 1.35962


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.lower(text), pattern, 1).try_cast("int")


def _all(text: Column, pattern: str) -> Column:
    bare = lambda s: F.regexp_replace(s, "[. ]", "").try_cast("int")
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), bare)


def _within(x: Column, low: int, high: int) -> Column:
    return F.when(x.between(low, high), x)


def mileage_km(text: Column) -> Column:
    """The greatest plausible mileage a text states."""
    said = F.concat(_all(text, KM), F.transform(_all(text, THOUSAND_KM), lambda k: k * 1000))
    return F.array_max(F.filter(said, lambda k: k.between(1, 2_000_000)))


def power_kw(text: Column) -> Column:
    ps = _within(_first(text, PS), 30, 1500)
    return F.coalesce(_within(_first(text, KW), 20, 1000), F.bround(ps / PS_OF_KW).cast("int"))


def first_year(text: Column) -> Column:
    """The year a text labels as the registration's, else the latest it names that isn't part of a date, a price or an inspection's."""
    dated = F.regexp_replace(F.lower(text), INSPECTION, " ")
    bare = F.array_max(F.filter(_all(dated, YEAR), lambda y: y.between(1980, 2035)))
    return F.coalesce(_first(text, LABELLED_YEAR), bare)


def displacement_cc(text: Column) -> Column:
    low = F.lower(text)
    litres = F.concat(F.regexp_extract(low, LITRES, 1), F.regexp_extract(low, LITRES, 2)).try_cast("int") * 100
    return F.coalesce(_within(_first(text, CCM), 600, 8000), _within(litres, 600, 8000))


def has_towbar(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(TOWBAR))


def cost_to_own(purchase: Column, fixed: Column, workshop: Column, per_100_km: Column, cents_per_unit: float, value: Column, km: int, years: int = 10, first_years: int = 5, rated_km: int = 15_000, later: float = 1.5) -> Column:
    """EUR over all years: purchase, fixed costs and workshop a month (half of the latter scaling with distance, dearer in
    later years), energy, less the value that is left."""
    share = 0.5 + 0.5 * km / rated_km
    garage = workshop * (12.0 * share * (first_years + (years - first_years) * later))
    energy = per_100_km / 100 * km * years * cents_per_unit / 100
    return F.round(purchase + fixed * (12.0 * years) + garage + energy - value).cast("long")

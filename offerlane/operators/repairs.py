"""What sellers write against what their forms say: prices, mileages, gearboxes, fees, rents, VAT, and which fields are verified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts state an asking price, an amount, a mileage, a gearbox, a dealer's fees, a gross price, a rent and its period.
ASK = "(?:preis|price|prezzo|prix|precio|prijs|vb|vhb)[ :=]*([0-9][0-9.]*) ?(?:€|eur)"
EUROS = "([0-9]{1,3}(?:[.][0-9]{3})+|[0-9]{4,7}) ?(?:€|eur)"
MILEAGE = "(?:laufleistung|kilometerstand)[ :]*([0-9][0-9.]*) ?km"
MANUAL, AUTOMATIC = "schaltgetriebe|handschaltung", "automatikgetriebe|automatik-"
FEES = ["überführung", "zulassung", "bereitstellung"]
FEE = "{kind}[^0-9.]{{0,12}}([0-9][0-9.]*) ?(?:€|eur)"
INCLUDED = "inkl(?:usive|[.])?[^.]*"
NET, GROSS, WITH_VAT = "netto|zzgl", "brutto[ :]*([0-9][0-9.]*) ?(?:€|eur)", "inkl. mwst"
HIRED, FROM_FLEET = "zu vermieten|mietpreis|verleih", "aus der vermietung|mietrückläufer"
PERIODS = {"DAY": "pro tag|tagesmiete", "WEEKEND": "wochenende", "WEEK": "pro woche|wochenmiete", "MONTH": "pro monat|monatsmiete"}
#: How many times the listed price a text's ask has to be before the listed one is a token.
TOKEN_FACTOR = 3
FEE_BAND, MILEAGE_BAND = (50, 3000), (1, 2_000_000)


def numbers_in(text: Column, pattern: str) -> Column:
    """The whole numbers a pattern's group matches, in order, thousands' dots left out."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda s: F.replace(s, F.lit("."), F.lit("")).try_cast("long"))


def asked_in_text(cents: Column, currency: Column, text: Column) -> Column:
    """The one ask a text labels, where that is far above the listed price; else the listed price."""
    asks = F.array_distinct(F.filter(numbers_in(text, ASK), lambda x: x > 0))
    asked = F.get(asks, F.lit(0)) * 100
    return F.when((currency == "EUR") & (F.size(asks) == 1) & (asked >= cents * TOKEN_FACTOR), asked).otherwise(cents)


def stated_price(cents: Column, currency: Column, text: Column) -> Column:
    """The first greater amount of the text, where the form's price is digits counted up from one."""
    digits = F.floor(cents / 100).cast("string")
    filler = (currency == "EUR") & (cents % 100 == 0) & (F.length(digits) >= 4) & F.startswith(F.lit("123456789"), digits)
    more = F.get(F.filter(numbers_in(text, EUROS), lambda x: x * 100 > cents), F.lit(0))
    return F.when(filler, F.coalesce(more * 100, cents)).otherwise(cents)


def stated_mileage(text: Column) -> Column:
    first = F.get(numbers_in(text, MILEAGE), F.lit(0))
    return F.when(first.between(*MILEAGE_BAND), first)


def stated_gearbox(text: Column) -> Column:
    """A text that names both says nothing."""
    manual, automatic = F.rlike(F.lower(text), F.lit(MANUAL)), F.rlike(F.lower(text), F.lit(AUTOMATIC))
    return F.when(manual & ~automatic, "MANUAL").when(automatic & ~manual, "AUTOMATIC")


def overridden(value: Column, stated: Column, verified: Column, field: str) -> tuple[Column, Column]:
    """A field's value and the verified fields, where the text may contradict the form."""
    differs = stated.isNotNull() & ~value.eqNullSafe(stated)
    return F.coalesce(stated, value), F.when(differs, F.array_remove(verified, field)).otherwise(verified)


def dealer_fees(text: Column) -> Column:
    """The sum in cents of what a dealer charges on top, each kind once; null where nothing is. Fees said to be included don't count."""
    said = F.regexp_replace(F.lower(text), INCLUDED, " ")
    each = [F.coalesce(F.get(F.filter(numbers_in(said, FEE.format(kind=k)), lambda x: x.between(*FEE_BAND)), F.lit(0)), F.lit(0)) for k in FEES]
    total = sum(each[1:], each[0])
    return F.when(total > 0, total * 100)


def gross_price(cents: Column, currency: Column, vat_percent: Column, text: Column) -> Column:
    """What a private buyer pays where the text calls the price net: the gross it states within VAT's reach, else the price with VAT."""
    gross, whole = numbers_in(text, GROSS), F.floor(cents / 100)
    near = F.get(F.filter(gross, lambda g: (g > whole) & (g * 10_000 <= whole * (100 + vat_percent) * 101)), F.lit(0))
    taxed = F.floor((cents * (100 + vat_percent) + 50) / 100)
    net = (currency == "EUR") & F.rlike(F.lower(text), F.lit(NET))
    settled = (F.size(gross) > 0) | F.contains(F.lower(text), F.lit(WITH_VAT))
    return F.when(~F.coalesce(net, F.lit(False)), cents).when(near.isNotNull(), near * 100).when(settled, cents).otherwise(taxed)


def hired_out(text: Column) -> Column:
    said = F.lower(text)
    return F.rlike(said, F.lit(HIRED)) & ~F.rlike(said, F.lit(FROM_FLEET))


def rent_period(text: Column) -> Column:
    """The period a text names first; null where it names none."""
    said = F.lower(text)
    at = {n: F.regexp_instr(said, F.lit(p)) for n, p in PERIODS.items()}
    return F.array_min(F.array_compact(F.array(*(F.when(a > 0, F.struct(a.alias("at"), F.lit(n).alias("period"))) for n, a in at.items()))))["period"]


def verified_by_presence(fields: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c.isNotNull(), n) for n, c in fields.items())))


def merged(structured: dict[str, Column], from_text: dict[str, Column]) -> dict[str, Column]:
    """A form's fields, and the text's where the form has none; what comes from text is never verified."""
    return {n: F.coalesce(c, from_text[n]) for n, c in structured.items()}


def verified_only(fields: dict[str, Column], verified: Column) -> dict[str, Column]:
    return {n: F.when(F.array_contains(verified, n), c) for n, c in fields.items()}

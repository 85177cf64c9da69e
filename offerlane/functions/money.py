"""Money as integer minor units: effective and landed prices, conversion, and prices read from text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries of the EU's VAT area, and units of a currency for one EUR until live rates are there.
EU_VAT_AREA = ["AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"]
RATES_PER_EUR = {"EUR": 1.0, "USD": 1.16, "GBP": 0.86, "CHF": 0.94, "PLN": 4.31, "DKK": 7.47, "SEK": 11.11, "CZK": 24.20, "NOK": 10.81, "RSD": 117.34}


@dataclass(frozen=True)
class ImportRules:
    home: str = "DE"
    vat_percent: int = 19
    duty_percent: int = 10
    enabled: bool = True


def effective_price(price: Column, currency: Column, shipping: Column, shipping_currency: Column) -> Column:
    """Price with shipping; shipping in another currency is left out."""
    return price + F.coalesce(F.when(currency == shipping_currency, shipping), F.lit(0))


def vat_due(origin: Column, rules: ImportRules = ImportRules()) -> Column:
    """Whether a purchase crosses the home country's VAT border."""
    if not rules.enabled or rules.vat_percent <= 0 or rules.home.upper() not in EU_VAT_AREA:
        return F.lit(False)
    return ~F.upper(origin).isin(EU_VAT_AREA)


def landed_price(base: Column, origin: Column, vehicle: Column, rules: ImportRules = ImportRules()) -> Column:
    """base with duty (vehicles) and then VAT on both, each truncated to a cent, where VAT is due."""
    duty = F.when(vehicle, _share(base, rules.duty_percent)).otherwise(F.lit(0))
    with_duty = base + duty
    return F.when(vat_due(origin, rules), with_duty + _share(with_duty, rules.vat_percent)).otherwise(base)


def _share(amount: Column, percent: int) -> Column:
    x = amount * F.lit(percent)
    return ((x - x % F.lit(100)) / F.lit(100)).cast("long")


def rate(currency: Column, rates: dict[str, float] = RATES_PER_EUR) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in rates.items() for v in pair]), currency)


def convert(amount: Column, source: Column, target: str = "EUR", rates: dict[str, float] = RATES_PER_EUR) -> Column:
    """Truncated to a minor unit; an amount of an unknown currency stays as it is."""
    return F.when(source == target, amount).otherwise(F.coalesce((amount / rate(source, rates) * F.lit(rates[target])).cast("long"), amount))


_NUMBER = r"[0-9][0-9., ]*"


#: Signs of currencies. Of several in a text, that of the upper row counts.
CURRENCY_SIGNS = [("€", "EUR"), ("EUR", "EUR"), ("$", "USD"), ("USD", "USD"), ("CHF", "CHF"), ("£", "GBP"), ("GBP", "GBP"), ("zł", "PLN"), ("PLN", "PLN"), ("Kč", "CZK"), ("CZK", "CZK"), ("DKK", "DKK"), ("SEK", "SEK"), ("NOK", "NOK")]


def currency_in(text: Column) -> Column:
    """The currency a text names by a sign, or null."""
    table = F.array(*(F.struct(F.lit(sign).alias("sign"), F.lit(code).alias("code")) for sign, code in CURRENCY_SIGNS))
    return F.get(F.filter(table, lambda row: F.contains(text, row["sign"])), 0)["code"]


def parse_cents(text: Column) -> Column:
    """The first number of a text, in cents. Of two kinds of separators the last is the decimal one; a single kind is
    decimal if at most two digits follow its last place."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, _NUMBER, 0), "[^0-9.,]", ""), "^[.,]+|[.,]+$", "")
    tail = F.length(F.regexp_extract(s, "[.,]([0-9]*)$", 1))
    dot, comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    last = F.regexp_extract(s, "([.,])[0-9]*$", 1)
    plain = (
        F.when(dot & comma & (last == ","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(dot & comma, F.replace(s, F.lit(","), F.lit("")))
        .when((dot | comma) & (tail <= 2), F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(F.regexp_replace(s, "[.,]", ""))
    )
    return F.round(plain.try_cast("double") * 100).try_cast("long")

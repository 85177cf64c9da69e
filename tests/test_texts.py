"""What sellers' texts say, by cases written by hand."""

import pytest
from pyspark.sql import functions as F

from offerlane.functions import drives, fit, health, money, sale, terms, vans, vehicles
from offerlane.functions import text as text_functions
from offerlane.operators import lookups, relevance, repairs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "cents, currency, text, want",
    [
        (10_000, "EUR", "Preis: 500 €", 50_000),
        (10_000, "EUR", "Prezzo 1.200 euro", 120_000),
        (10_000, "EUR", "Preis 250 €", 10_000),  # not three times as much
        (10_000, "EUR", "Preis 500 €, VB 450 €", 10_000),  # two asks
        (10_000, "EUR", "Preis 2019 gekauft", 10_000),  # no currency
        (10_000, "USD", "Preis 500 €", 10_000),
        (10_000, "EUR", None, 10_000),
        (10_000, "EUR", "", 10_000),
    ],
)
def test_asked_in_text(spark, cents, currency, text, want):
    assert value(spark, repairs.asked_in_text(F.lit(cents), F.lit(currency), F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("cents, text, want", [(1_234_500, "56.999€ VB, 52.000€", 5_699_900), (1_234_500, "VB", 1_234_500), (1_234_600, "56.999€", 1_234_600), (12_300, "56.999€", 12_300), (1_234_500, None, 1_234_500)])
def test_stated_price(spark, cents, text, want):
    assert value(spark, repairs.stated_price(F.lit(cents), F.lit("EUR"), F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "text, want",
    [("Überführung 990 €, Zulassung 150 €, Zulassung 170 €", 114_000), ("inkl. Überführung 990 €", None), ("inkl. Überführung 990 €. Zulassung 150 €", 15_000), ("inklusive Überführung 990 €", None), ("Überführung 9.000 €", None), ("", None), (None, None)],
)
def test_dealer_fees(spark, text, want):
    assert value(spark, repairs.dealer_fees(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("Netto, brutto 118 €", 11_800), ("Netto zzgl. MwSt.", 11_900), ("Netto, inkl. MwSt.", 10_000), ("brutto", 10_000), ("Netto, brutto 500 €", 10_000), (None, 10_000)])
def test_gross_price(spark, text, want):
    assert value(spark, repairs.gross_price(F.lit(10_000), F.lit("EUR"), F.lit(19), F.lit(text).cast("string"))) == want


def test_rents(spark):
    assert value(spark, repairs.rent_period(F.lit("am Wochenende oder pro Tag"))) == "WEEKEND"
    assert value(spark, repairs.rent_period(F.lit("kaufen"))) is None
    assert value(spark, repairs.hired_out(F.lit("Mietpreis 40 €"))) and not value(spark, repairs.hired_out(F.lit("aus der Vermietung, Mietpreis war 40 €")))


def test_drives(spark):
    assert [value(spark, drives.model_capacity_gb(F.lit(t))) for t in ("ST16000NM001G", "WD80EFAX", "WD5000AAKX", "MG08ACA16TE", "x")] == [16000, 8000, 500, 16000, None]
    assert [value(spark, drives.model_family(F.lit(t))) for t in ("ST16000NM001G", "WD80EFAX", "MG08ACA16TE", "x")] == ["Seagate NM001G", "WD EFAX", "MG08", None]
    assert [value(spark, drives.hours(F.lit(t))) for t in ("12.500 Betriebsstunden", "Versand in 24 h", "300 h, 41.000 h")] == [12500, None, 41000]
    assert [value(spark, drives.one_of(F.lit(t), drives.INTERFACES)) for t in ("SAS HDD", "SAS oder SATA", "Sasha")] == ["SAS", None, None]
    assert value(spark, drives.unit_cents(F.lit("199,50 € pro Stück"))) == 19950


def test_vehicles(spark):
    assert [value(spark, vehicles.mileage_km(F.lit(t))) for t in ("132 TKM", "89.900 km, 45.000 km", "180 km/h", "4.000.000 km")] == [132_000, 89_900, None, None]
    assert [value(spark, vehicles.power_kw(F.lit(t))) for t in ("103 kW", "150 PS", "9000 kW")] == [103, 110, None]
    assert [value(spark, vehicles.first_year(F.lit(t))) for t in ("EZ 03/2016", "gebaut 2011, TÜV 2027", "Baujahr 1999, 2005", "x")] == [2016, 2011, 1999, None]


def test_codes(spark):
    part = lambda t: value(spark, relevance.is_the_part(F.lit(t), "51167204283"))
    assert part("BMW 51 16 7 204 283") and part("Spiegel 7204283") and not part("Spiegel 7204284")
    another = lambda t: value(spark, relevance.names_another_model(F.lit(t), "ib3740c31"))
    assert another("ICY BOX IB-287-C31") and not another("IB-3740-C") and not another("Crucial DDR4-3200") and not another("IB-3740-C31")


SOLD = {
    "leider schon verkauft": True, "wurde reserviert.": True, "500 verkauft, noch da": False, "already sold": True, "1.200+ sold": False, "nicht mehr verfügbar": True, "wird verkauft": False,
    "is no longer available": True, "der hund ist weggelaufen": False, "": False, "ist\nweg": True, "ist weg!": True, "has been sold": True, "nicht mehr zu haben": True, "noch zu haben": False,
    "nie meer beschikbaar": True, "déjà vendu": True, "al verkocht.": True, "wird verkauft, da ich gewechselt habe": False, "schon 500 verkauft": False, "nicht mehr dabei": False, "ist das schon weg": True,
}
SOLD_TITLES = {
    "VERKAUFT": True, "[SOLD] Canon": True, "Canon - reserviert": True, "12 verkocht": False, "1.000+ sold": False, "Pixel 9 (vendu)": True, "Bosch unverkauft": False, "Sold out tour poster": True, "no longer available": True,
    "Netbook": False, "": False, "vergeben!": True, "Réservé pour Anne": True, "seit 2019 verkauft": False, "schon verkauft": True, "goldsold": False, "sold": True, "nicht mehr da": True, "verhandelt": True, "Weg": False,
}


def test_texts_and_titles_say_sold(spark):
    for cases, says in ((SOLD, sale.text_says_sold), (SOLD_TITLES, sale.title_says_sold)):
        rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", says(F.col("t")).alias("s")).collect()
        assert {r["t"]: r["s"] for r in rows} == cases


def test_sale_marks(spark):
    assert [value(spark, sale.says_defective(F.lit(t))) for t in ("für bastler", "wird als defekt verkauft", "aus einem defekten laptop")] == [True, True, False]
    assert [value(spark, sale.pickup_only(F.lit(t))) for t in ("nur selbstabholer", "nur an abholer", "kein versand", "keinen versand", "versand möglich")] == [True, True, True, True, False]
    shipping = lambda free, pickup, cents, currency: value(spark, sale.shipping_eur(F.lit(free), F.lit(pickup), F.lit(cents).cast("long"), F.lit(currency)))
    assert [shipping(True, False, 500, "EUR"), shipping(False, True, 500, "EUR"), shipping(False, False, 550, "EUR"), shipping(False, False, 550, "USD"), shipping(False, False, None, "EUR")] == [0, 0, 5.5, None, None]


def test_shown_texts(spark):
    assert value(spark, text_functions.shown_price(F.lit(123456789), F.lit("EUR"))) == "1.234.567,89 €"
    assert value(spark, text_functions.shown_price(F.lit(5), F.lit("CHF"))) == "0,05 CHF"
    assert [value(spark, fit.hours_label(F.lit(h))) for h in (0.7, 1.0, 6.7)] == ["~45 min", "~1 h", "~7 h"]
    assert [value(spark, text_functions.pack_gb(F.lit(t))) for t in ("2x16GB RAM", "1x 4TB", "4 x 1 TB und 2x8gb", "16 GB")] == [32, 0, 4000, 0]
    assert value(spark, text_functions.longest_name(F.lit("a Red Ring here"), ["ring", "red ring", "bolt"])) == "red ring"
    message = text_functions.fill(F.lit("{a} and {b}"), {"a": F.lit("x")})
    assert value(spark, message) == "x and {b}" and value(spark, text_functions.has_open_place(message))


def test_fit_parts(spark):
    parts = fit.weighed([("a", F.lit(1.0), 0.3), ("b", F.lit(None), 0.1)])
    assert value(spark, fit.score(parts)) == pytest.approx((0.3 + 0.45 * 0.1) / 0.4)
    assert [value(spark, fit.size_wish(F.lit(n).cast("int"), (2, 3), (1, 5))) for n in (2, 5, 9, None)] == [1.0, 0.6, 0.1, 0.35]
    assert value(spark, fit.charging_cent(F.lit(90), F.lit(40))) == pytest.approx(0.9 * (0.4 * 8 + 0.6 * 37.3) + 0.1 * 56)


def test_conditions(spark):
    cases = {
        "Neu": "NEW", "brand new": "NEW", "Nuovo (altro)": "NEW", "Neuf (autre)": "NEW", "wie neu": "LIKE_NEW", "Ausstellungsstück": "LIKE_NEW", "Als nieuw": "LIKE_NEW", "Gebraucht": "USED", "gebraucht, gut": "GOOD", "Usato": "USED",
        "Pre-owned": "USED", "very good": "VERY_GOOD", "Sehr gut": "VERY_GOOD", "In nette staat": "GOOD", "acceptable": "ACCEPTABLE", "refurbished by maker": "REFURBISHED", "Reconditionné": "REFURBISHED", "Defekt, für Ersatzteile": "PARTS_ONLY",
        "Per ricambi o non funzionante": "PARTS_ONLY", "Pour pièces détachées": "PARTS_ONLY", "Para piezas o no funciona": "PARTS_ONLY", "unknown": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", text_functions.condition_of(F.col("label")).alias("c")).collect()
    assert {r["label"]: r["c"] for r in rows} == cases


def test_currencies(spark):
    cases = {"1 €": "EUR", "EUR 3": "EUR", "$5": "USD", "CHF 12 (ca. 11 €)": "EUR", "£3": "GBP", "5 zł": "PLN", "12 Kč": "CZK", "49 DKK": "DKK", "3": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", money.currency_in(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_as_of_takes_the_last_state(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (1, 3, "d")], "k int, t int, name string")
    states = spark.createDataFrame([(1, 2, 20), (1, 3, 30), (1, 8, 80), (2, 10, 0)], "k int, at int, v int")
    got = {(r["name"], r["v"], r["at"]) for r in lookups.as_of(rows, states, ["k"], "t", "at").collect()}
    assert got == {("a", 30, 3), ("b", None, None), ("c", None, None), ("d", 30, 3)}


def test_normalised_words(spark):
    cases = {
        "Apple i-Phone 15 ProMax, 256 Gigabyte": "apple iphone 15 promax 256 gb", "RTX 3060Ti Größe 2 TeraByte!": "rtx 3060 ti groesse 2 tb", "Café 7,9 Zoll S23+": "cafe 7p9 zoll s23 plus", "i pad 500 Go": "ipad 500 gb", "": "",
        "Iphon 13pro + Hülle": "iphone 13 pro huelle", "i i phone 256go, go home": "i iphone 256 gb go home", "Ipfon 11": "iphone 11", "1.250,5": "1 250 5", "Wie Neu+": "wie neu", "6+ 7 +": "6 plus 7", "S24FE": "s24fe", "24FE": "24 fe",
        "12.5": "12 5", "3.5.": "3p5", "(Neu) [OVP]": "neu ovp", "ÉTÉ": "ete", "512GB": "512gb", "256 giga": "256 gb", "  ": "", "go 5 go": "go 5 gb", "i phone i phone": "iphone iphone", "+": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", terms.normalise(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


def test_vetoes(spark):
    said = lambda f, t, q: value(spark, f(terms.normalise(F.lit(t)), q))
    assert said(terms.is_consumable, "Staubbeutel für Kärcher", "kärcher") and not said(terms.is_consumable, "Kärcher mit Staubbeutel", "kärcher") and not said(terms.is_consumable, "Staubbeutel", "staubbeutel")
    assert said(terms.is_built_in, "Dell Laptop mit Samsung SSD", "ssd") and not said(terms.is_built_in, "SSD für Laptop", "ssd") and not said(terms.is_built_in, "Laptop mit SSD", "laptop ssd")


def test_van_sizes(spark):
    told = lambda t: (value(spark, vans.lengths(F.lit(t))), value(spark, vans.heights(F.lit(t))))
    assert told("VW Crafter L3H2 TDI") == ([3], [2])
    assert told("Transit lang, Hochdach") == ([3, 4], [2, 3])
    assert told("Master L2 lang") == ([2], [1, 2, 3, 4])  # a sign that leaves nothing is passed over
    assert told("Ducato Maxi L5H3") == ([5], [3]) and told("Sprinter") == ([1, 2, 3, 4, 5], [1, 2, 3, 4])


SCREEN = "ID Name\n05 Reallocated Sectors Count 100 100 10 {}\n09 Power-On Hours 90 90 0 41234\nC5 Current Pending Sector Count 100 100 0 {}\nC6 Uncorrectable Sector Count 100 100 0 {}\n"


@pytest.mark.parametrize("screen, want", [(SCREEN.format(0, 0, 0), "CLEAN"), (SCREEN.format(8, 0, 0), "WORN"), (SCREEN.format(800, 0, 0), "FAILING"), (SCREEN.format(0, 2, 0), "FAILING"), (SCREEN.format(0, 0, 1), "FAILING"), (SCREEN.format("?", 0, 0), "UNREADABLE"), ("hello", "UNREADABLE"), ("", "UNREADABLE")])
def test_health_screens(spark, screen, want):
    n = {a: health.count_of(F.lit(screen), a) for a in health.ATTRIBUTES}
    assert value(spark, health.verdict(n["reallocated"], n["pending"], n["uncorrectable"], F.lit(False))) == want
    assert value(spark, n["hours"]) == (41234 if "Hours" in screen else None)

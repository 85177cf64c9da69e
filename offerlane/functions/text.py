"""Texts: tidying, tokens, word sequences, sizes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(text: Column) -> Column:
    """Control characters and object marks become blanks, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1F\\x7F\\x{FFFC}]", " "), " +", " "))


def fold_german(text: Column) -> Column:
    return F.replace(F.translate(F.lower(text), "äöü", "aou"), F.lit("ß"), F.lit("ss"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def glue_thousands(text: Column) -> Column:
    """1.234.567 -> 1234567, in three passes."""
    for _ in range(3):
        text = F.regexp_replace(text, "([0-9])[.]([0-9]{3})($|[^0-9])", "$1$2$3")
    return text


def glue_units(text: Column) -> Column:
    """2 tb -> 2tb."""
    return F.regexp_replace(text, "([0-9]) +(gb|tb|mb)($|[^a-z0-9])", "$1$2$3")


def tokens(text: Column) -> Column:
    return F.filter(F.split(glue_units(glue_thousands(F.lower(text))), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, each joined without blanks."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), ""))).otherwise(F.array().cast("array<string>"))


def says_blocked(words: Column, blocked: list[str]) -> Column:
    """Whether a blocked word stands there whole, or glued from two to four words."""
    forms = F.concat(words, *(ngrams(words, n) for n in (2, 3, 4)))
    return F.arrays_overlap(forms, F.array(*map(F.lit, blocked)))


def sizes_gb(text: Column) -> Column:
    """The distinct storage sizes a text names, in GB, ascending."""
    pairs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+ ?(?:gb|tb))(?:$|[^a-z0-9])"), 1)
    gb = F.transform(pairs, lambda p: F.regexp_extract(p, "^[0-9]+", 0).try_cast("int") * F.when(F.endswith(p, F.lit("tb")), F.lit(1000).cast("long")).otherwise(F.lit(1).cast("long")))
    return F.array_sort(F.array_distinct(gb))


#: What labels say of a condition, by language. A word counts wherever it stands; one with ^ only at the
#: start of a label, one with = only as the whole of it.
CONDITION_WORDS = {
    "PARTS_ONLY": {"it": ["ricambi", "non funzionante"], "fr": ["pièces", "pieces"], "es": ["para piezas", "no funciona"], "de": ["ersatzteil", "defekt"], "en": ["parts"]},
    "LIKE_NEW": {"de": ["wie neu", "vorführ", "aussteller", "ausstellungsstück"], "en": ["like new"], "nl": ["als nieuw"], "it": ["come nuovo"], "fr": ["comme neuf"], "es": ["como nuevo"]},
    "NEW": {"de": ["=neu"], "en": ["=new", "=brand new"], "nl": ["=nieuw"], "it": ["^nuovo"], "fr": ["^neuf"], "es": ["^nuevo"]},
    "REFURBISHED": {"de": ["generalüberholt"], "en": ["refurbished"], "it": ["ricondizionat"], "fr": ["reconditionn"], "es": ["reacondicionad"]},
    "VERY_GOOD": {"de": ["sehr gut", "exzellent"], "en": ["very good"]},
    "GOOD": {"de": ["gut"], "en": ["good"], "nl": ["nette staat"]},
    "ACCEPTABLE": {"de": ["akzeptabel"], "en": ["acceptable"]},
    "USED": {"de": ["gebraucht"], "en": ["used", "pre-owned"], "nl": ["gebruikt"], "it": ["usato"], "fr": ["occasion"], "es": ["usado", "segunda mano"]},
}


def condition_of(label: Column) -> Column:
    """The condition a label states; null if none. Of several, the one that stands first in CONDITION_WORDS counts, as a
    broken thing's label may call it used, and a good one's too."""
    t = F.trim(F.lower(label))
    holds = {"^": lambda w: F.rlike(t, F.lit(f"^{w}($|[^a-z])")), "=": lambda w: t == w}
    found = [
        F.when(holds[w[0]](w[1:]) if w[0] in holds else F.contains(t, F.lit(w)), condition)
        for condition, by_language in CONDITION_WORDS.items()
        for words in by_language.values()
        for w in words
    ]
    return F.coalesce(*found)


def site_of(url: Column) -> Column:
    """The host of an address, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]*)", 1)), "^www[.]", "")


def clean_url(url: Column) -> Column:
    """An address without its fragment, tracking parameters and session ids."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, ";jsessionid=[^?#]*", "")
    kept = F.regexp_replace(bare, "(utm_[a-z]+|gclid|fbclid|ref)=[^&#]*&?", "")
    return F.regexp_replace(kept, "[?&]+$", "")


def product_key(url: Column) -> Column:
    """An address without scheme, www., query, fragment and closing slash."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://(www[.])?", ""), "[?#].*$", "")), "/+$", "")


def is_front_page(url: Column) -> Column:
    return F.rlike(url, F.lit("^[a-zA-Z]+://[^/?#]+/?([?#].*)?$"))


def row_id(url: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat(url, F.lit("|"), title)), 1, 16)


def share_words(a: Column, b: Column) -> Column:
    """Whether at least 0.8 of the shorter of two word sets, three words or more, are in the longer."""
    shorter = F.least(F.size(a), F.size(b))
    return (shorter >= 3) & (F.size(F.array_intersect(a, b)) >= shorter * 0.8)


def pack_gb(text: Column) -> Column:
    """The greatest product of a count (two or more) and a size, as in 2x16GB; 0 without one."""
    packs = F.regexp_extract_all(F.lower(text), F.lit("[0-9]{1,2} ?x ?[0-9]{1,4} ?(?:gb|tb)"), 0)
    number = lambda m, p: F.regexp_extract(m, p, 1).cast("long")
    size = lambda m: number(m, "x ?([0-9]+)") * F.when(F.endswith(m, F.lit("tb")), 1000).otherwise(1)
    told = F.transform(packs, lambda m: F.when(number(m, "^([0-9]+)") >= 2, number(m, "^([0-9]+)") * size(m)).otherwise(F.lit(0).cast("long")))
    return F.coalesce(F.array_max(told), F.lit(0).cast("long"))


def longest_name(title: Column, names: list[str]) -> Column:
    """The longest of the names that stand in a title as whole words, the last by alphabet of equally long ones."""
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    found = [F.when(F.contains(padded, F.lit(f" {n} ")), F.struct(F.lit(len(n)).alias("size"), F.lit(n).alias("name"))) for n in names]
    return F.array_max(F.array_compact(F.array(*found)))["name"]


_SYMBOLS = {"EUR": "€", "USD": "$"}


def shown_price(cents: Column, currency: Column) -> Column:
    """1.234,50 €"""
    whole = F.translate(F.format_number((cents - cents % 100) / 100, 0), ",", ".")
    symbol = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _SYMBOLS.items() for x in kv)), currency), currency)
    return F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "), symbol)


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def has_open_place(message: Column) -> Column:
    return F.rlike(message, F.lit("[{][a-z]+[}]"))

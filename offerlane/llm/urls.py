"""URL filter: rules indexed by their rarest literal token.

Each rule is a regular expression over a whole url, with the literal tokens that every url it fits must hold. Over the
urls at hand the frequency of those tokens is counted, and each rule goes under its rarest. A url's own tokens fetch the
candidate rules, and only those run their expressions. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is one literal map; beyond, urls and index are joined by token.
INLINE_RULES = 2_000
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """rule: what is reported. pattern: matched in the lower-cased host, U+0001, path, U+0001 and lower-cased rest of a
    url. tokens: runs of a-z and 0-9 that every url it fits has, whole. Base rules take precedence over the others; among
    equals the longer rule wins, then the greater name."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool = False


def host_rule(rule: str, verdict: str) -> Rule:
    """A rule like example.net/en/: that host and its subdomains, and paths that start so. Paths keep their case."""
    host, slash, path = rule.partition("/")
    whole = path[: path.rfind("/") + 1].lower()  # what follows the last slash may be the start of a longer token
    return Rule(rule, verdict, rf"^([^\x01]*\.)?{re.escape(host)}\x01{re.escape(slash + path)}", tuple(re.findall(_TOKEN, f"{host} {whole}")), True)


#: Fixed values of the contract.
BASE_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
#: The method's own: hosts and addresses that carry spam, sessions or machine-made copies.
OWN_RULES = [
    Rule("spam-farm", "block", r"^([^\x01]*[.])?spam-farm[.]", ("spam", "farm")),
    Rule("casino", "block", r"^([^\x01]*[.-])?casino[.-]", ("casino",)),
    Rule("phpsessid", "block", r"[?&]phpsessid=[a-z0-9]{8,}", ("phpsessid",)),
    Rule("jsessionid", "block", r"[?&]jsessionid=[a-z0-9]{8,}", ("jsessionid",)),
    Rule("print", "block", r"[?&]print=(1|true)(&|$)", ("print",)),
    Rule("replytocom", "block", r"[?&]replytocom=[0-9]+", ("replytocom",)),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    lower = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({_TOKEN})"), 1))


def index_rules(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under the token of its own that fewest of urls(form) hold. Only the rules' own tokens are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = urls.select(F.explode(F.array_intersect(_tokens(F.col("form")), F.array(*map(F.lit, wanted)))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}  # as many rows as the rules have tokens at most
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


_FIELDS = "base, length, rule, verdict, pattern"


def _literal(r: Rule) -> Column:
    # the order of fields makes the best rule the greatest struct
    return F.struct(F.lit(r.base).alias("base"), F.lit(len(r.rule)).alias("length"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None, inline: int = INLINE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages, repeated rows too.

    rule is the longest base rule that fits, else null; verdict is that rule's, else the method's: block where one of
    its own rules fits, allow otherwise. A null url, or one without ://, has an empty host and path and is allowed.
    Tokens are runs of a-z and 0-9 of the lower-cased url. Other columns of pages aren't read.
    """
    rules = BASE_RULES + OWN_RULES if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.regexp_extract("url", r"[?#][\s\S]*", 0), F.lit("")).alias("rest"))
    rows = rows.select("page_id", "host", "path", F.concat_ws("\x01", "host", "path", F.lower("rest")).alias("form"))
    index = index_rules(rows, rules)
    if len(rules) <= inline:
        by_token = F.create_map(*[c for t, rs in index.items() for c in (F.lit(t), F.array(*map(_literal, rs)))])
        fetched = F.flatten(F.transform(F.array_intersect(_tokens(F.col("form")), F.array(*map(F.lit, index))), lambda t: F.element_at(by_token, t)))
        best = F.array_max(F.filter(fetched, lambda r: F.rlike(F.col("form"), r["pattern"])))
        found = rows.select("page_id", "host", "path", best.alias("best"))
    else:
        table = pages.sparkSession.createDataFrame([(t, r.base, len(r.rule), r.rule, r.verdict, r.pattern) for t, rs in index.items() for r in rs], "token string, base boolean, length int, rule string, verdict string, pattern string")
        forms = rows.select("form").distinct().select("form", F.explode(_tokens(F.col("form"))).alias("token"))
        fits = forms.join(table, "token").where("rlike(form, pattern)").groupBy("form").agg(F.expr(f"max(struct({_FIELDS}))").alias("best"))
        found = rows.join(fits, "form", "left").select("page_id", "host", "path", "best")
    return found.select("page_id", "host", "path", F.when(F.col("best.base"), F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))

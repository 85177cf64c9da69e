"""Queries over codes in texts and over markets as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlane.operators import cooccurrence, naming
from offerlane.plans.registry import query
from offerlane.sources import connector
from offerlane.sources.tables import table

_CONTEXTS_SQL = r"""t AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT w, unnest(list_filter(range(1, len(w) + 1), lambda k: regexp_matches(w[k], '[0-9]'))) AS k FROM t),
c AS (SELECT row_number() OVER () AS c, * FROM (SELECT DISTINCT w[k] AS code, list_concat(w[greatest(k - 5, 1):k - 1], w[k + 1:k + 5]) AS words FROM i)),
n AS (SELECT DISTINCT c, code, word FROM (SELECT c, code, unnest(words) AS word FROM c) WHERE regexp_matches(word, '^\p{L}{4,}$')),
f AS (SELECT code, word, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 2)"""


def _contexts(spark, sf_dir):
    return cooccurrence.code_contexts(table(spark, sf_dir, "documents"), "text", least_length=1)


@query(f"WITH {_CONTEXTS_SQL} SELECT code, word, n FROM f")
def words_of_codes(spark, sf_dir):
    """The words that stand around a number in two places or more, over all whole texts."""
    return cooccurrence.code_words(_contexts(spark, sf_dir), least=2)


@query(f"""WITH {_CONTEXTS_SQL}, k AS (SELECT n.* FROM n JOIN f USING (code, word))
SELECT x.code, x.word AS a, y.word AS b, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.word < y.word GROUP BY ALL HAVING count(*) >= 2""")
def word_pairs_of_codes(spark, sf_dir):
    """The pairs of such words that stand around the number together, twice at least."""
    return cooccurrence.code_pairs(_contexts(spark, sf_dir), least=2)


@query("""SELECT p_brand AS market, p_partkey AS offer, p_name AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part
WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND contains(p_name, 'ring') AND CAST(round(p_retailprice * 100) AS BIGINT) BETWEEN 92000 AND 98000""")
def market_scan(spark, sf_dir):
    """A question to three markets within a band of prices, which they filter themselves."""
    asked = connector.Asked(("Brand#1", "Brand#2", "Brand#3"), 92000, 98000, "ring")
    return connector.market_offers(spark, f"{sf_dir}/part.parquet", asked)


_W = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS_SQL = "SELECT {key} AS k, unnest(range(0, len(w) - {n} + 1)) AS i, {n} AS n, w FROM {source} WHERE len(w) >= {n}"


def _runs_sql(source: str, key: str) -> str:
    return "SELECT k, i AS first_word, n, array_to_string(w[i + 1:i + n], ' ') AS name FROM (" + " UNION ALL ".join(_RUNS_SQL.format(source=source, key=key, n=n) for n in (2, 3, 5)) + ")"


@query(f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark), d AS (SELECT doc_id, {_W} AS w FROM documents), names AS (SELECT DISTINCT name FROM ({_runs_sql("b", "item_id")})),
m AS (SELECT r.k, r.first_word, r.n, name FROM ({_runs_sql("d", "doc_id")}) r JOIN names USING (name)),
o AS (SELECT *, max(first_word + n) OVER (PARTITION BY k ORDER BY first_word, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT k AS doc_id, name, first_word, CAST(n AS INTEGER) AS n_words FROM o WHERE before IS NULL OR first_word + n > before""")
def named_phrases(spark, sf_dir):
    """Where runs of two, three and five words of the benchmark's items stand in whole texts: the longest at each place."""
    w = table(spark, sf_dir, "benchmark").select(naming.words_of("text").alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    names = w.select(F.explode(F.concat(runs(2), runs(3), runs(5))).alias("name"))
    return naming.longest_names(table(spark, sf_dir, "documents"), "doc_id", "text", names, "name")

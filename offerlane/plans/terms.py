"""Queries over words of searches and titles, sources and their pages, models, bids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlane.functions import health, terms, vans
from offerlane.operators import registry as models
from offerlane.operators import scoring, windows
from offerlane.plans.offers import _EUR_SQL
from offerlane.plans.others import _COS, _VEC_SQL
from offerlane.plans.registry import query
from offerlane.sources import markets
from offerlane.sources.tables import LISTINGS_SQL, OBSERVATIONS_SQL, observations, table

_WITH, _OBS = f"WITH {LISTINGS_SQL}", f"WITH {OBSERVATIONS_SQL}"
n_rows = lambda: F.count(F.lit(1))
six = lambda c: F.round(c * 1e6) / 1e6

# words

# words as rows: cut at blanks, then into simple words, then numbers from what is glued to them; then tables of units and names
_WORDS_SQL = r"""w0 AS (SELECT doc_id, nth, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, row_number() OVER () AS nth, list_filter(regexp_split_to_array(
  translate(replace(replace(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ü', 'ue'), 'ö', 'oe'), 'ä', 'ae'), 'éèêëàâáçôóùûúîïí', 'eeeeaaacoouuuiii'), '[^a-z0-9.,+]+'), lambda x: x <> '') AS words FROM documents)),
w1 AS (SELECT nth, i, unnest(p) AS w, generate_subscripts(p, 1) AS j FROM (SELECT nth, i, CASE WHEN regexp_matches(trim(w, '.,'), '^[0-9][.,][0-9]$') THEN [replace(replace(trim(w, '.,'), '.', 'p'), ',', 'p')]
  ELSE string_split_regex(regexp_replace(translate(trim(w, '.,'), '.,', '  '), '([0-9]) *[+]', '\1 plus ', 'g'), '[ +]+') END AS p FROM w0)),
w2 AS (SELECT nth, i, j, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM (SELECT nth, i, j, CASE WHEN regexp_extract(w, '^[0-9]+([a-z]+)$', 1) IN (SELECT unnest(['gigabyte', 'gigabytes', 'giga', 'gigas', 'go', 'terabyte', 'terabytes', 'fe', 'ti', 'pro']))
  THEN [regexp_extract(w, '^[0-9]+'), regexp_extract(w, '[a-z]+$')] ELSE [w] END AS p FROM w1 WHERE w <> '')),
units(w, unit) AS (VALUES ('gigabyte', 'gb'), ('gigabytes', 'gb'), ('giga', 'gb'), ('gigas', 'gb'), ('go', 'gb'), ('terabyte', 'tb'), ('terabytes', 'tb')),
names(a, b, name) AS (VALUES ('i', 'phone', 'iphone'), ('i', 'phon', 'iphone'), ('i', 'pfon', 'iphone'), ('i', 'fon', 'iphone'), ('i', 'pad', 'ipad'), ('iphon', NULL, 'iphone'), ('ipfon', NULL, 'iphone'), ('ifon', NULL, 'iphone')),
w3 AS (SELECT nth, i, j, k, coalesce(CASE WHEN regexp_matches(before, '^[0-9p]*[0-9]$') THEN unit END, w) AS w FROM (SELECT *, lag(w) OVER (PARTITION BY nth ORDER BY i, j, k) AS before FROM w2) LEFT JOIN units USING (w)),
w4 AS (SELECT *, lag(w) OVER (PARTITION BY nth ORDER BY i, j, k) AS before, lead(w) OVER (PARTITION BY nth ORDER BY i, j, k) AS after FROM w3),
w5 AS (SELECT w4.*, coalesce(two.name, one.name, w) AS word FROM w4 LEFT JOIN names two ON two.a = w AND two.b = after LEFT JOIN names one ON one.a = w AND one.b IS NULL WHERE NOT EXISTS (FROM names n WHERE n.a = before AND n.b = w)),
normal AS (SELECT d.doc_id, coalesce(t, '') AS t FROM (SELECT doc_id, row_number() OVER () AS nth FROM documents) d LEFT JOIN (SELECT nth, string_agg(word, ' ' ORDER BY i, j, k) AS t FROM w5 GROUP BY nth) USING (nth))"""


@query(f"WITH {_WORDS_SQL} SELECT doc_id, md5(t) AS words_md5 FROM normal")
def normalised_texts(spark, sf_dir):
    """Whole texts in one spelling of names, units and marks (told by the MD5 of what comes out)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(terms.normalise(F.coalesce("text", F.lit("")))).alias("words_md5"))


@query(f"""WITH {_WORDS_SQL}, n AS (SELECT doc_id, concat(' ', t, ' ') AS t FROM normal) SELECT doc_id, regexp_matches(t, ' (schleifpapier|(staub|filter)beutel|tintenpatrone|tonerkartusche|saegeblatt|ersatzakku) ')
 AND NOT regexp_matches(t, ' (mit|inkl|with|und) (schleifpapier|(staub|filter)beutel|tintenpatrone|tonerkartusche|saegeblatt|ersatzakku) ') AS consumable,
 contains(t, ' the ') AND regexp_matches(t, ' (laptop|notebook|desktop|server|nas|konsole) ') AND least(CASE WHEN contains(t, ' laptop ') THEN strpos(t, ' laptop ') ELSE 1000000000 END, CASE WHEN contains(t, ' notebook ') THEN strpos(t, ' notebook ') ELSE 1000000000 END,
 CASE WHEN contains(t, ' desktop ') THEN strpos(t, ' desktop ') ELSE 1000000000 END, CASE WHEN contains(t, ' server ') THEN strpos(t, ' server ') ELSE 1000000000 END, CASE WHEN contains(t, ' nas ') THEN strpos(t, ' nas ') ELSE 1000000000 END, CASE WHEN contains(t, ' konsole ') THEN strpos(t, ' konsole ') ELSE 1000000000 END) < strpos(t, ' the ') AS built_in FROM n""")
def relevance_vetoes(spark, sf_dir):
    """Texts about a consumable, or about a machine that holds what is asked for."""
    t = table(spark, sf_dir, "documents").select("doc_id", terms.normalise(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", terms.is_consumable(F.col("t"), "the").alias("consumable"), terms.is_built_in(F.col("t"), "the").alias("built_in"))


_OPENERS_SQL = "w AS (SELECT DISTINCT regexp_extract(lower(text), '^[a-z]+') AS word FROM conversations WHERE text IS NOT NULL)"


@query(f"WITH {_OPENERS_SQL} SELECT a.word, max_by(b.word, len(b.word)) AS head FROM w a JOIN w b ON ends_with(a.word, b.word) AND len(b.word) >= 2 AND len(a.word) > len(b.word) GROUP BY a.word")
def compound_heads(spark, sf_dir):
    """The longest other word that a word ends with, by a join on the word's endings."""
    w = table(spark, sf_dir, "conversations").where("text is not null").select(F.regexp_extract(F.lower("text"), "^[a-z]+", 0).alias("word")).distinct()
    ends = w.where(F.length("word") > 2).select("word", F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 1), lambda i: F.substring("word", F.length("word") - i + 1, i))).alias("head"))
    return ends.join(w.select(F.col("word").alias("head")), "head").groupBy("word").agg(F.max_by("head", F.length("head")).alias("head"))


@query("""WITH t AS (SELECT lower(regexp_extract(text, '^[^ .]*[ .]?[^ .]*')) AS term, conv_id % 7 AS search FROM conversations WHERE text IS NOT NULL), o AS (SELECT trim(term) AS term, count(DISTINCT search) AS searches FROM t WHERE trim(term) <> '' GROUP BY 1)
SELECT term, searches, CASE WHEN term = 'the' THEN 'the search itself' WHEN contains(term, ' ') THEN 'a phrase' WHEN contains(term, 'the') OR contains('the', term) THEN 'spelled inside the search' WHEN regexp_matches(term, '(ung|ing)$') THEN 'names the job' WHEN searches > 3 THEN 'offered under many searches' ELSE 'worth trying' END AS why FROM o""")
def term_verdicts(spark, sf_dir):
    """Why a suggested term is tried or not: the first reason that holds."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    t = c.select(F.trim(F.lower(F.regexp_extract("text", "^[^ .]*[ .]?[^ .]*", 0))).alias("term"), (F.col("conv_id") % 7).alias("search")).where("term <> ''")
    o = t.distinct().groupBy("term").agg(F.count("search").alias("searches"))
    term = F.col("term")
    why = (
        F.when(term == "the", "the search itself")
        .when(F.contains(term, F.lit(" ")), "a phrase")
        .when(F.contains(term, F.lit("the")) | F.contains(F.lit("the"), term), "spelled inside the search")
        .when(F.rlike(term, F.lit("(ung|ing)$")), "names the job")
        .when(F.col("searches") > 3, "offered under many searches")
        .otherwise("worth trying")
    )
    return o.select("term", "searches", why.alias("why"))


_ALIASES = [("small ring", "rings", "small"), ("red ring", "rings", "red"), ("ring", "rings", None), ("blue bolt", "bolts", "blue"), ("bolt", "bolts", None), ("widget", "widgets", None)]


@query(f"""WITH a(alias, make, model) AS (VALUES {", ".join("('{}', '{}', {})".format(x, y, f"'{z}'" if z else "NULL") for x, y, z in _ALIASES)}), h AS (SELECT p_partkey AS part, alias, make, model FROM part, a WHERE contains(concat(' ', lower(p_name), ' '), concat(' ', alias, ' '))),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY len(alias) DESC, alias) AS rn FROM h) SELECT part, make, model FROM r WHERE rn = 1""")
def resolved_models(spark, sf_dir):
    """Make and model of a title by the longest alias in it; an alias of a make alone names no model."""
    aliases = spark.createDataFrame(_ALIASES, "alias string, make string, model string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit(" "), F.lower("p_name"), F.lit(" ")).alias("t"))
    words = F.filter(F.split(F.trim("t"), " +"), lambda w: w != "")
    runs = F.flatten(F.array(F.transform(words, lambda w: w), F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))).otherwise(F.array().cast("array<string>"))))
    met = p.select("part", F.explode(F.array_distinct(runs)).alias("alias")).join(F.broadcast(aliases), "alias")  # the fixed list of aliases
    best = met.groupBy("part").agg(F.max_by(F.struct("make", "model"), F.struct(F.length("alias").alias("n"), "alias")).alias("b"))
    return best.select("part", "b.make", "b.model")


# sources


@query(f"{_WITH} SELECT id, platform, ({_EUR_SQL}) AS cents FROM listings WHERE platform IN ('EUROPE', 'AMERICA') AND NOT sold AND contains(lower(title), 'ring') AND ({_EUR_SQL}) BETWEEN 100000 AND 900000")
def source_search(spark, sf_dir):
    """One question put to several markets: each answers with what it can filter itself, the rest is filtered after."""
    asked = markets.Question("ring", 1000, 9000)
    return markets.search(spark, sf_dir, ["EUROPE", "AMERICA"], asked).select("id", "platform", "cents")


@query("""WITH p AS (SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS BIGINT) AS page FROM documents), g AS (SELECT source, page, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT source, min(page) FILTER (n < 20) AS short FROM g GROUP BY source)
SELECT g.source, page, n FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source WHERE page <= coalesce(short, page) AND page < 3""")
def page_stops(spark, sf_dir):
    """Which pages of a source are read: three at most, and none after a short one. Only the first 60 rows of a source can
    matter, and no more than these leave a task."""
    first = windows.first_per_key(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 60)
    page = F.floor((F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1) / 20)
    g = first.select("source", page.alias("page")).groupBy("source", "page").agg(n_rows().alias("n"))
    before = F.min(F.when(F.col("n") < 20, F.col("page"))).over(Window.partitionBy("source"))
    return g.withColumn("short", before).where(F.col("page") <= F.coalesce("short", "page")).select("source", "page", "n")


@query("""WITH a AS (SELECT event_id, concat(event_type, ':', user_id % 4) AS key, ts, lag(ts) OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS before FROM events) SELECT event_id, key, before IS NOT NULL AND ts - before <= INTERVAL 15 MINUTE AS hit FROM a""")
def cache_hits(spark, sf_dir):
    """Whether a search's answer is still cached from the ask before: the same normalised question within 15 minutes. An ask
    is a hit if another stands before it in its quarter of an hour, or late enough in the quarter before: two aggregates a
    quarter, so that no question's asks come together."""
    quarter = F.unix_date(F.col("ts").cast("date")) * 96 + F.floor((F.hour("ts") * 60 + F.minute("ts")) / 15)
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(":"), (F.col("user_id") % 4).cast("string")).alias("key"), "ts", quarter.alias("quarter"))
    ends = e.groupBy("key", "quarter").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.max("ts").alias("last"))
    ends = ends.select("key", "quarter", "first", F.lit(None).cast(e.schema["ts"].dataType).alias("last")).union(ends.select("key", F.col("quarter") + 1, F.lit(None).cast(ends.schema["first"].dataType), "last"))
    near = ends.groupBy(F.col("key").alias("_key"), F.col("quarter").alias("_quarter")).agg(F.max("first").alias("first"), F.max("last").alias("last"))
    hit = (F.struct("ts", "event_id") > F.col("first")) | F.coalesce(F.col("ts") - F.col("last") <= F.expr("INTERVAL 15 MINUTE"), F.lit(False))
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("quarter").eqNullSafe(F.col("_quarter"))
    return e.join(near, same).select("event_id", "key", F.coalesce(hit, F.lit(False)).alias("hit"))


@query(f"{_OBS}, p AS (SELECT search, offer, time_bucket(INTERVAL 6 HOURS, seen) AS part, price_cents FROM observations) SELECT search, offer, min(part) AS emitted FROM p WHERE price_cents >= 1000 GROUP BY search, offer")
def partial_answers(spark, sf_dir):
    """In which part of an answer an offer is first shown: the first in which it passes, and never again."""
    part = F.window(F.col("seen").cast("timestamp"), "6 hours")["start"].cast("timestamp_ntz")
    return observations(spark, sf_dir).where("price_cents >= 1000").groupBy("search", "offer").agg(F.min("seen").alias("seen")).select("search", "offer", part.alias("emitted"))


@query("""WITH l AS (SELECT user_id AS bid, max(ts) FILTER (event_type = 'signup') AS planned, max(ts) FILTER (event_type = 'click') AS placed, max(ts) FILTER (event_type = 'error') AS failed, max(ts) FILTER (event_type = 'purchase' AND value > 20) AS won, max(ts) FILTER (event_type = 'view' AND value > 30) AS ended FROM events GROUP BY user_id)
SELECT bid, CASE WHEN won IS NOT NULL AND won > coalesce(placed, TIMESTAMP '1970-01-01') THEN 'WON' WHEN placed IS NOT NULL AND ended > placed THEN 'ENDED' WHEN failed IS NOT NULL AND failed > coalesce(placed, TIMESTAMP '1970-01-01') THEN 'NOT_PLACED' WHEN placed IS NOT NULL THEN 'PLACED' WHEN planned IS NOT NULL THEN 'WAITING' ELSE 'SKIPPED' END AS state FROM l""")
def bid_states(spark, sf_dir):
    """A bid's state from the last of each kind of event it had: maxima that are merged before anything is shuffled."""
    last = lambda c, n: F.max(F.when(c, F.col("ts"))).alias(n)
    kind, value = F.col("event_type"), F.col("value")
    l = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("bid")).agg(last(kind == "signup", "planned"), last(kind == "click", "placed"), last(kind == "error", "failed"), last((kind == "purchase") & (value > 20), "won"), last((kind == "view") & (value > 30), "ended"))
    since = lambda c: F.col(c) > F.coalesce("placed", F.lit("1970-01-01").cast("timestamp_ntz"))
    state = F.when(since("won"), "WON").when(F.col("ended") > F.col("placed"), "ENDED").when(since("failed"), "NOT_PLACED").when(F.col("placed").isNotNull(), "PLACED").when(F.col("planned").isNotNull(), "WAITING").otherwise("SKIPPED")
    return l.select("bid", state.alias("state"))


# models


@query(f"""WITH {_VEC_SQL}, s AS (SELECT e.vec_id, e.label, x.label AS said, round({_COS.format(a="e.v", b="x.v")} * 1000000) / 1000000 AS sim, x.vec_id AS other FROM e JOIN e x ON x.vec_id % 10 <> e.vec_id % 10 WHERE e.vec_id % 50 = 0 AND x.label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rn FROM s) SELECT vec_id, said, sim, said = label AS right FROM r WHERE rn = 1""".replace("AS right", "AS hit"))
def held_out_nearest(spark, sf_dir):
    """The label of the likest vector of another fold (seller), and whether it is right."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.col("vec_id") % 10)
    near = scoring.nearest(e.where("vec_id % 50 = 0"), e.where("label is not null"), "vec_id", "embedding", 1, by="fold").where(F.col("by") != F.col("vec_id") % 10)
    best = near.groupBy("vec_id").agg(F.max_by(F.struct("other", "sim"), F.struct("sim", (-F.col("other")).alias("o"))).alias("b")).select("vec_id", "b.other", "b.sim")
    labels = e.select(F.col("vec_id").alias("other"), F.col("label").alias("said"))
    own = e.select("vec_id", "label")
    return best.join(labels, "other").join(own, "vec_id").select("vec_id", "said", "sim", (F.col("said") == F.col("label")).alias("hit"))


@query(f"""WITH {_VEC_SQL}, s AS (SELECT e.vec_id, max({_COS.format(a="e.v", b="x.v")}) FILTER (x.label = 1) AS love, max({_COS.format(a="e.v", b="x.v")}) FILTER (x.label = 9) AS dislike FROM e JOIN e x ON x.vec_id <> e.vec_id WHERE e.vec_id % 50 = 0 AND x.label IN (1, 9) GROUP BY e.vec_id)
SELECT vec_id, round(greatest(0, least(1, 0.5 + 0.25 * (love - dislike))) * 10000) / 10000 AS score FROM s""")
def image_affinity(spark, sf_dir):
    """Half, raised by a quarter of how much liker a vector is to the loved ones than to the disliked."""
    e = table(spark, sf_dir, "embeddings")
    near = scoring.nearest(e.where("vec_id % 50 = 0"), e.where("label in (1, 9)"), "vec_id", "embedding", 1, by="label", digits=None)
    g = near.groupBy("vec_id").agg(F.max(F.when(F.col("by") == 1, F.col("sim"))).alias("love"), F.max(F.when(F.col("by") == 9, F.col("sim"))).alias("dislike"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("love") - F.col("dislike"))))
    return g.select("vec_id", (F.round(s * 1e4) / 1e4).alias("score"))


@query("""WITH d AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT m, doc_id, quality, CASE m WHEN 'length' THEN least(1.0, n_chars / 3000.0)::DOUBLE ELSE CASE WHEN n_chars >= t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score
 FROM d, (VALUES ('length'), ('learned bar')) v(m), (SELECT avg(n_chars) AS t FROM d WHERE quality = 1 AND doc_id % 5 <> 0) b), a AS (SELECT m, avg(CASE WHEN (score >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM s WHERE doc_id % 5 = 0 GROUP BY m),
w AS (SELECT m FROM a ORDER BY accuracy DESC, m LIMIT 1) SELECT m AS model, doc_id, round(score * 1000000) / 1000000 AS score, m = (SELECT m FROM w) AS active FROM s""")
def model_registry(spark, sf_dir):
    """All models are trained and score all rows; the one that is best on held-out rows is active."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return models.scored_by_all(rows, [models.Length(3000), models.LearnedBar()], "quality", F.col("doc_id") % 5 == 0).select("model", "doc_id", six(F.col("score")).alias("score"), "active")


# vans and drives

_VAN_TEXTS_SQL = "v AS (SELECT p_partkey AS part, concat('Crafter ', CASE WHEN p_size % 3 <> 0 THEN concat('L', p_size % 5 + 1, CASE WHEN p_size % 2 = 0 THEN concat('H', p_size % 4 + 1) ELSE '' END, ' ') ELSE '' END, CASE p_type WHEN 'LARGE' THEN 'Hochdach, lang' WHEN 'SMALL' THEN 'Flachdach kurz' WHEN 'MEDIUM' THEN 'mittellang' WHEN 'PROMO' THEN 'Maxi; Superhochdach' ELSE p_name END) AS t FROM part)"


@query(f"""WITH {_VAN_TEXTS_SQL}, c AS (SELECT part, t, nullif(regexp_extract(t, '[ ]L([1-5])', 1), '') AS l, nullif(regexp_extract(t, '[0-9]H([1-4])', 1), '') AS h FROM v), n AS (SELECT part, t, CASE WHEN l IS NULL THEN [1, 2, 3, 4, 5] ELSE [CAST(l AS INTEGER)] END AS lx, CASE WHEN h IS NULL THEN [1, 2, 3, 4] ELSE [CAST(h AS INTEGER)] END AS hx FROM c),
s AS (SELECT part, lx, hx, CASE WHEN contains(t, 'kurz') THEN [1, 2] WHEN contains(t, 'mittellang') THEN [2, 3] WHEN contains(t, ', lang') THEN [3, 4] WHEN contains(t, 'Maxi') THEN [3, 4, 5] ELSE [1, 2, 3, 4, 5] END AS lw, CASE WHEN contains(t, 'Superhoch') THEN [3, 4] WHEN contains(t, 'Hochdach') THEN [2, 3] WHEN contains(t, 'Flach') THEN [1] ELSE [1, 2, 3, 4] END AS hw FROM n)
SELECT part, array_to_string(list_sort(CASE WHEN len(list_intersect(lx, lw)) > 0 THEN list_intersect(lx, lw) ELSE lx END), ' ') AS lengths, array_to_string(list_sort(CASE WHEN len(list_intersect(hx, hw)) > 0 THEN list_intersect(hx, hw) ELSE hx END), ' ') AS heights FROM s""")
def van_sizes(spark, sf_dir):
    """Which lengths and heights a van may have, by codes and words: each sign narrows what is left."""
    size = F.col("p_size")
    code = F.when(size % 3 != 0, F.concat(F.lit("L"), size % 5 + 1, F.when(size % 2 == 0, F.concat(F.lit("H"), size % 4 + 1)).otherwise(""), F.lit(" "))).otherwise("")
    word = F.when(F.col("p_type") == "LARGE", "Hochdach, lang").when(F.col("p_type") == "SMALL", "Flachdach kurz").when(F.col("p_type") == "MEDIUM", "mittellang").when(F.col("p_type") == "PROMO", "Maxi; Superhochdach").otherwise(F.col("p_name"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("Crafter "), code, word).alias("t"))
    told = lambda c: F.array_join(c.cast("array<string>"), " ")
    return t.select("part", told(vans.lengths(F.col("t"))).alias("lengths"), told(vans.heights(F.col("t"))).alias("heights"))


@query("""WITH c AS (SELECT p_partkey AS part, p_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CASE WHEN p_size % 5 = 0 THEN p_size * 9 ELSE 0 END END AS re, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END END AS pe, CASE WHEN p_size % 13 = 0 THEN 3 ELSE 0 END AS un FROM part)
SELECT part, CASE WHEN pe > 0 OR un > 0 OR re > 100 THEN 'FAILING' WHEN re > 0 THEN 'WORN' WHEN re = 0 AND (pe = 0 OR (pe IS NULL AND p_size % 8 = 0)) AND un = 0 THEN 'CLEAN' ELSE 'UNREADABLE' END AS verdict, CAST(p_size * 1000 AS BIGINT) AS hours FROM c""")
def health_verdicts(spark, sf_dir):
    """What a health screen's text says of a drive: its counts are read line by line, then judged."""
    size = F.col("p_size")
    line = lambda number, name, value: F.concat(F.lit(f"{number} {name} 100 100 10 "), value.cast("string"), F.lit("\n"))
    text = F.concat(
        F.lit("ID Attribute Current Worst Threshold Raw\n"),
        F.when(size % 7 != 0, line("05", "Reallocated Sectors Count", F.when(size % 5 == 0, size * 9).otherwise(0))).otherwise(""),
        line("09", "Power-On Hours", size * 1000),
        F.when(size % 4 != 0, line("C5", "Current Pending Sector Count", F.when(size % 11 == 0, 1).otherwise(0))).otherwise(""),
        line("C6", "Uncorrectable Sector Count", F.when(size % 13 == 0, 3).otherwise(0)),
    )
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size", text.alias("t"))
    read = {a: health.count_of(F.col("t"), a) for a in health.ATTRIBUTES}
    return t.select("part", health.verdict(read["reallocated"], read["pending"], read["uncorrectable"], size % 8 == 0).alias("verdict"), read["hours"].alias("hours"))

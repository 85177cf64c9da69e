"""Queries over observations, texts, pages, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlane.functions import money, numbers, text
from offerlane.operators import aggregates, joins, scoring, windows
from offerlane.plans.registry import query
from offerlane.sources.shared import checkpointed
from offerlane.sources.tables import OBSERVATIONS_SQL, observations, table

_OBS = f"WITH {OBSERVATIONS_SQL}"
six = lambda c: F.round(c * 1e6) / 1e6


@query(f"""{_OBS}, l AS (SELECT *, lag(price_cents) OVER w AS before, row_number() OVER w AS rn FROM observations WINDOW w AS (PARTITION BY search, offer ORDER BY seen, event_id))
SELECT search, offer, seen, price_cents, before, CASE WHEN rn = 1 THEN 'FIRST_SEEN' ELSE 'PRICE_CHANGED' END AS event FROM l WHERE rn = 1 OR before <> price_cents""")
def offer_history(spark, sf_dir):
    got = windows.changes(observations(spark, sf_dir), ["search", "offer"], ["seen", "event_id"], "price_cents")
    return got.select("search", "offer", "seen", "price_cents", "before", "event")


@query(f"""{_OBS}, r AS (SELECT DISTINCT search, CAST(seen AS DATE) AS day FROM observations), o AS (SELECT DISTINCT search, offer, CAST(seen AS DATE) AS day FROM observations),
d AS (SELECT search, day, lag(day) OVER (PARTITION BY search ORDER BY day) AS prev, lead(day) OVER (PARTITION BY search ORDER BY day) AS next FROM r),
p AS (SELECT o.*, prev, next, lag(o.day) OVER (PARTITION BY search, offer ORDER BY o.day) AS was, lead(o.day) OVER (PARTITION BY search, offer ORDER BY o.day) AS again FROM o JOIN d USING (search, day))
SELECT search, offer, next AS day, 'NOT_KEPT' AS event FROM p WHERE next IS NOT NULL AND again IS DISTINCT FROM next
UNION ALL SELECT search, offer, day, 'KEPT_AGAIN' FROM p WHERE was IS NOT NULL AND was <> prev""")
def kept_between_runs(spark, sf_dir):
    """A search's runs are its days: offers that a run no longer shows, and those that come back. Only rows that are
    there are compared with the calendar of runs, so nothing is multiplied out."""
    o = observations(spark, sf_dir).select("search", "offer", F.col("seen").cast("date").alias("day")).distinct()
    ws, wo = Window.partitionBy("search").orderBy("day"), Window.partitionBy("search", "offer").orderBy("day")
    runs = o.select("search", "day").distinct().withColumn("prev", F.lag("day").over(ws)).withColumn("next", F.lead("day").over(ws))
    p = o.join(runs, ["search", "day"]).withColumn("was", F.lag("day").over(wo)).withColumn("again", F.lead("day").over(wo))
    gone = p.where(F.col("next").isNotNull() & ~F.col("again").eqNullSafe(F.col("next"))).select("search", "offer", F.col("next").alias("day"), F.lit("NOT_KEPT").alias("event"))
    back = p.where(F.col("was").isNotNull() & (F.col("was") != F.col("prev"))).select("search", "offer", "day", F.lit("KEPT_AGAIN").alias("event"))
    return gone.unionByName(back)


@query(f"{_OBS} SELECT event_id, search, offer, min(price_cents) OVER (PARTITION BY search, offer ORDER BY seen, event_id ROWS UNBOUNDED PRECEDING) AS best FROM observations")
def running_best(spark, sf_dir):
    return windows.running(observations(spark, sf_dir), ["search", "offer"], ["seen", "event_id"], "best", F.min("price_cents")).select("event_id", "search", "offer", "best")


@query(f"""{_OBS}, s AS (SELECT search, offer, max(price_cents) AS best, max(seen) AS last_seen FROM observations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY best DESC, offer) AS place FROM s)
SELECT search, offer, best, last_seen, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def top_ten(spark, sf_dir):
    s = observations(spark, sf_dir).groupBy("search", "offer").agg(F.max("price_cents").alias("best"), F.max("seen").alias("last_seen"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("best"), "offer"))).where("place <= 10")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_rate(spark, sf_dir):
    return windows.rolling_count(table(spark, sf_dir, "events"), ["event_type"], "ts", 3600).select("event_id", "n")


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS began, count(*) AS n, round(sum(value) * 100) / 100 AS total FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("t", "6 hours")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value") * 100) / 100).alias("total"))
    return g.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("began"), "n", "total")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 7200)


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) % 2 AS kind FROM events GROUP BY ALL), c AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY user_id ORDER BY day) IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS changed FROM d),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, kind, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY user_id, run, kind""")
def day_runs(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg((F.count(F.lit(1)) % 2).alias("kind"))
    return windows.islands(d, ["user_id"], "day", "kind")


@query("""WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, count(*) FILTER (value > 20) AS blocked FROM events GROUP BY ALL), a AS (SELECT * FROM h WHERE n >= 3 AND blocked / n >= 0.5),
g AS (SELECT *, lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS before FROM a) SELECT event_type, hour, n, blocked FROM g WHERE before IS NULL OR hour - before > INTERVAL 1 HOUR""")
def block_alarms(spark, sf_dir):
    """Hours in which half of the requests or more were blocked, unless the hour before alarmed already."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    h = e.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 20).alias("blocked"))
    a = h.where((F.col("n") >= 3) & (F.col("blocked") / F.col("n") >= 0.5))
    before = F.lag("hour").over(Window.partitionBy("event_type").orderBy("hour"))
    return a.withColumn("before", before).where("before is null or hour > before + interval 1 hour").drop("before")


@query("""WITH r AS (SELECT event_type, event_id, ts, value > 10 AS resolved, row_number() OVER (PARTITION BY event_type, value > 10 ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT event_type, event_id, ts, resolved FROM r WHERE rn <= CASE WHEN resolved THEN 50 ELSE 200 END""")
def retention_by_class(spark, sf_dir):
    """The newest 50 resolved and 200 unresolved of each kind."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", (F.col("value") > 10).alias("resolved"))
    few = windows.first_per_key(e, ["event_type", "resolved"], [F.desc("ts"), "event_id"], 200)
    rank = F.row_number().over(Window.partitionBy("event_type", "resolved").orderBy(F.desc("ts"), "event_id"))
    return few.withColumn("rn", rank).where("not resolved or rn <= 50").drop("rn")


@query("""WITH l AS (SELECT event_id, user_id, value > 15 AS told, lag(value > 15) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, told FROM l WHERE told IS DISTINCT FROM before""")
def log_on_change(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("told", F.col("value") > 15)
    before = F.lag("told").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", before).where(~F.col("told").eqNullSafe(F.col("before"))).select("event_id", "user_id", "told")


@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-25'""")
def tracked_first_last(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))
    return g.where("last_seen >= timestamp_ntz'2024-01-25 00:00:00'")


@query("""WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'), o AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase')
SELECT p.event_id, count(o.event_id) AS outcomes, min(o.ts) AS first_outcome FROM p LEFT JOIN o ON o.user_id = p.user_id AND o.ts > p.ts AND o.ts <= p.ts + INTERVAL 1 DAY GROUP BY p.event_id""")
def delayed_outcomes(spark, sf_dir):
    """Predictions (views) and what followed them within a day (purchases): an equi join by user and day, with a time
    range; an outcome stands under its own day and the day before."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff("ts", F.lit("2000-01-01")))
    p = e.where("event_type = 'view'").select("event_id", "user_id", "day", F.col("ts").alias("seen"))
    o = e.where("event_type = 'purchase'").select("user_id", F.explode(F.array("day", F.col("day") - 1)).alias("day"), F.col("ts").alias("bought"))
    followed = (F.col("bought") > F.col("seen")) & (F.col("bought") <= F.col("seen") + F.expr("interval 1 day"))
    pairs = p.alias("p").join(o.alias("o"), (F.col("p.user_id") == F.col("o.user_id")) & (F.col("p.day") == F.col("o.day")) & followed, "left")
    return pairs.groupBy("event_id").agg(F.count("bought").alias("outcomes"), F.min("bought").alias("first_outcome"))


# texts

_TOKENS_SQL = """t AS (SELECT doc_id, lang, source, list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([0-9])[.]([0-9]{3})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9])[.]([0-9]{3})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9])[.]([0-9]{3})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9]) +(gb|tb|mb)($|[^a-z0-9])', '\\1\\2\\3', 'g'), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents)"""


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.tokens(F.coalesce("text", F.lit(""))).alias("words"))


@query(f"""WITH {_TOKENS_SQL}, n AS (SELECT source, count(*) AS n FROM t GROUP BY source), x AS (SELECT source, unnest(list_distinct(words)) AS token FROM t), c AS (SELECT source, token, count(*) AS n_rows FROM x GROUP BY ALL)
SELECT source, token, n_rows, round(n_rows / n * 1000000) / 1000000 AS share FROM c JOIN n USING (source) WHERE n_rows >= 2""")
def doc_term_share(spark, sf_dir):
    """In what share of a source's texts each token stands (tokens of two texts at least)."""
    got = aggregates.share_carrying(_words(spark, sf_dir), F.col("words"), ["source"]).where("n_rows >= 2")
    return got.withColumn("share", six(F.col("share")))


@query(f"""WITH {_TOKENS_SQL}, x AS (SELECT lang, source, unnest(list_distinct(words)) AS token FROM t), h AS (SELECT source, token, count(*) AS n_rows FROM x GROUP BY ALL), s AS (SELECT source, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT token, count(*) AS all_rows FROM x GROUP BY token), z AS (SELECT count(*) AS n FROM t), o AS (SELECT source, token, n_rows, round(ln((n_rows / s.n) / greatest(all_rows / z.n, 1e-4)) * 1000000) / 1000000 AS odds FROM h JOIN s USING (source) JOIN b USING (token), z WHERE n_rows >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY odds DESC, n_rows DESC, token) AS rn FROM o WHERE odds >= 2) SELECT source, token, n_rows, odds FROM r WHERE rn <= 2""")
def term_log_odds(spark, sf_dir):
    """The two tokens of each source that stand out most against all texts."""
    w = _words(spark, sf_dir)
    here = aggregates.share_carrying(w, F.col("words"), ["source"])
    back = aggregates.share_carrying(w.withColumn("all", F.lit(0)), F.col("words"), ["all"]).select("token", F.col("share").alias("background"))
    odds = here.where("n_rows >= 2").join(back, "token").withColumn("odds", six(F.ln(F.col("share") / F.greatest("background", F.lit(1e-4))))).where("odds >= 2")
    return windows.first_per_key(odds.select("source", "token", "n_rows", "odds"), ["source"], [F.desc("odds"), F.desc("n_rows"), "token"], 2)


_BLOCKED = ["license", "thethe", "ofthe", "isthein"]


@query(f"""WITH {_TOKENS_SQL}, g AS (SELECT doc_id, words, list_concat(words, CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || words[i + 1]) ELSE [] END, CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || words[i + 1] || words[i + 2]) ELSE [] END,
 CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: words[i] || words[i + 1] || words[i + 2] || words[i + 3]) ELSE [] END) AS forms FROM t)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, list_has_any(forms, {_BLOCKED}) AS blocked FROM g""")
def ngram_block(spark, sf_dir):
    """Whether a blocked word stands in a text, whole or glued from two to four words."""
    return _words(spark, sf_dir).select("doc_id", F.size("words").alias("n_words"), text.says_blocked(F.col("words"), _BLOCKED).alias("blocked"))


@query("""SELECT source, count(*) AS n, round(avg(CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 1.0 ELSE 0.0 END) * 1000000) / 1000000 AS share, count(*) >= 5 AND max(CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 1 ELSE 0 END) = 0 AS answered_else,
avg(CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 1.0 ELSE 0.0 END) < 0.02 AS irrelevant FROM documents GROUP BY source""")
def answer_sanity(spark, sf_dir):
    """For each source's answer: the share that carries the word, whether none does, and whether too few do."""
    hit = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("license")).cast("int")
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("s"), F.max(hit).alias("m"))
    return g.select("source", "n", six(F.col("s")).alias("share"), ((F.col("n") >= 5) & (F.col("m") == 0)).alias("answered_else"), (F.col("s") < 0.02).alias("irrelevant"))


_TEXTS_SQL = "x AS (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS txt FROM documents UNION ALL SELECT 'page', page_id, coalesce(html, '') FROM pages)"


def _texts(spark, sf_dir):
    """The whole texts of documents and the whole pages."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("txt"))
    return d.unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("txt")))


@query(f"""WITH {_TEXTS_SQL}, m AS (SELECT *, trim(replace(regexp_extract(txt, '[0-9][0-9., ]*'), ' ', ''), '.,') AS s FROM x),
y AS (SELECT *, regexp_extract(s, '[.,]([0-9]*)$', 1) AS tail, regexp_matches(s, '[.].*[,]|[,].*[.]') AS mixed, regexp_matches(s, ',[0-9]*$') AS comma_last, regexp_matches(s, '[.,]') AS marked FROM m)
SELECT kind, id, CASE WHEN regexp_matches(txt, '€|EUR') THEN 'EUR' WHEN regexp_matches(txt, '[$]|USD') THEN 'USD' WHEN contains(txt, 'CHF') THEN 'CHF' WHEN regexp_matches(txt, '£|GBP') THEN 'GBP' WHEN regexp_matches(txt, 'zł|PLN') THEN 'PLN' WHEN regexp_matches(txt, 'Kč|CZK') THEN 'CZK'
 WHEN contains(txt, 'DKK') THEN 'DKK' WHEN contains(txt, 'SEK') THEN 'SEK' WHEN contains(txt, 'NOK') THEN 'NOK' END AS currency,
TRY_CAST(round(TRY_CAST(CASE WHEN mixed AND comma_last THEN replace(replace(s, '.', ''), ',', '.') WHEN mixed THEN replace(s, ',', '') WHEN marked AND length(tail) <= 2 THEN replace(s, ',', '.') ELSE replace(replace(s, '.', ''), ',', '') END AS DOUBLE) * 100) AS BIGINT) AS cents FROM y""")
def money_parse(spark, sf_dir):
    """The first amount in whole texts, in the ways that markets write them, and the currency they name."""
    return _texts(spark, sf_dir).select("kind", "id", money.currency_in(F.col("txt")).alias("currency"), money.parse_cents(F.col("txt")).alias("cents"))


@query(f"""WITH {_TEXTS_SQL}, n AS (SELECT kind, id, list_transform(regexp_extract_all(lower(txt), '([0-9]+ ?[gt]b)(?:$|[^a-z0-9])', 1), lambda p: CASE WHEN contains(p, 't') THEN 1000 ELSE 1 END * TRY_CAST(regexp_extract(p, '[0-9]+') AS INTEGER)) AS gb FROM x)
SELECT kind, id, concat('[', coalesce(array_to_string(list_sort(list_distinct(gb)), ', '), ''), ']') AS sizes FROM n""")
def sizes_in_text(spark, sf_dir):
    """The storage sizes that whole texts name."""
    sizes = F.array_join(text.sizes_gb(F.col("txt")).cast("array<string>"), ", ")
    return _texts(spark, sf_dir).select("kind", "id", F.concat(F.lit("["), sizes, F.lit("]")).alias("sizes"))


@query(f"""WITH {_TEXTS_SQL}, t AS (SELECT kind, id, trim(lower(txt)) AS t FROM x) SELECT kind, id, CASE WHEN regexp_matches(t, 'ricambi|non funzionante|pi[èe]ces|para piezas|no funciona|ersatzteil|defekt|parts') THEN 'PARTS_ONLY'
 WHEN regexp_matches(t, 'wie neu|vorführ|ausstell(er|ungsst)|like new|als nieuw|com(e nuovo|me neuf|o nuevo)') THEN 'LIKE_NEW' WHEN regexp_matches(t, '^(neu|(brand )?new|nieuw)$|^(nuovo|neuf|nuevo)($|[^a-z])') THEN 'NEW'
 WHEN regexp_matches(t, 'generalüberholt|refurbished|ricondizionat|reconditionn|reacondicionad') THEN 'REFURBISHED' WHEN regexp_matches(t, 'sehr gut|exzellent|very good') THEN 'VERY_GOOD' WHEN regexp_matches(t, 'gut|good|nette staat') THEN 'GOOD'
 WHEN regexp_matches(t, 'akzeptabel|acceptable') THEN 'ACCEPTABLE' WHEN regexp_matches(t, 'gebraucht|used|pre-owned|gebruikt|usato|occasion|usado|segunda mano') THEN 'USED' END AS condition FROM t""")
def condition_parse(spark, sf_dir):
    """The condition that whole texts state."""
    return _texts(spark, sf_dir).select("kind", "id", text.condition_of(F.col("txt")).alias("condition"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www[.]', '') AS site, regexp_replace(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://(www[.])?', ''), '[?#].*$', '')), '/+$', '') AS product,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), ';jsessionid=[^?#]*', ''), '(utm_[a-z]+|gclid|fbclid|ref)=[^&#]*&?', '', 'g'), '[?&]+$', '') AS clean, regexp_matches(url, '^[a-zA-Z]+://[^/?#]+/?([?#].*)?$') AS front_page FROM pages""")
def url_site_key(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.site_of(u).alias("site"), text.product_key(u).alias("product"), text.clean_url(u).alias("clean"), text.is_front_page(u).alias("front_page"))


@query("SELECT page_id, left(sha1(concat(url, '|', regexp_extract(html, '<title>([^<]*)', 1))), 16) AS id FROM pages")
def row_sha1_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.row_id(F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)).alias("id"))


@query("SELECT page_id, url FROM pages p WHERE NOT regexp_matches(url, '^[a-zA-Z]+://[^/]*example[.]net(/|$|[?#])') AND contains(lower(html), 'the')")
def web_scan(spark, sf_dir):
    """Pages of shops that no source of its own covers."""
    return table(spark, sf_dir, "pages").where(~F.rlike("url", F.lit("^[a-zA-Z]+://[^/]*example[.]net(/|$|[?#])")) & F.contains(F.lower("html"), F.lit("the"))).select("page_id", "url")



_WORD_HASHES_SQL = "h AS (SELECT doc_id, CAST(concat('0x', left(md5(unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')))), 15)) AS BIGINT) AS h FROM documents)"
_PRINT_SQL = f"""{_WORD_HASHES_SQL}, n AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(60))} FROM h GROUP BY doc_id),
p AS (SELECT doc_id, {" + ".join(f"(CASE WHEN 2 * b{i} > n THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(60))} AS p FROM n)"""
_PRINTS_SQL = f"{_PRINT_SQL}, g AS (SELECT p, min(doc_id) AS k, count(*) AS copies FROM p WHERE least(bit_count(p), 64 - bit_count(p)) >= 16 GROUP BY p)"


def _prints(spark, sf_dir):
    """(doc_id, p): a print of 60 bits of each whole text's distinct words; likeness of words is likeness of bits."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long"))
    return joins.majority_print(table(spark, sf_dir, "documents").select("doc_id", hashes.alias("h")), "doc_id", "h")


@query(f"""WITH {_PRINT_SQL}, f AS (SELECT p, min(doc_id) AS k FROM p GROUP BY p) SELECT a.k AS a, b.k AS b, CAST(bit_count(xor(a.p, b.p)) AS INTEGER) AS bits FROM f a JOIN f b ON a.k < b.k AND bit_count(xor(a.p, b.p)) <= 3
UNION ALL SELECT f.k, p.doc_id, 0 FROM p JOIN f USING (p) WHERE p.doc_id <> f.k""")
def hamming_copies(spark, sf_dir):
    """Pairs of prints that differ in at most 3 bits, each named by its first text, and each further text of a print with
    the print's first at 0 bits: no two texts whose prints are so near are without a link."""
    prints = checkpointed(_prints(spark, sf_dir))
    return joins.hamming_pairs(prints, "doc_id", "p").unionByName(joins.print_copies(prints, "doc_id", "p"))


@query(f"WITH {_PRINTS_SQL} SELECT p.doc_id, g.k AS first_id, g.copies FROM p JOIN g USING (p)")
def hamming_members(spark, sf_dir):
    """Which print, named by its first text, each text has, and how many have it."""
    return joins.print_members(_prints(spark, sf_dir), "doc_id", "p")


# vectors

_VEC_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query(f"""WITH {_VEC_SQL}, s AS (SELECT e.vec_id, x.vec_id AS other, x.label, round({_COS.format(a="e.v", b="x.v")} * 1000000) / 1000000 AS sim FROM e JOIN e x ON x.vec_id <> e.vec_id WHERE e.vec_id % 50 = 0 AND x.label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rn FROM s), w AS (SELECT vec_id, label, greatest(0.01, (sim + 1) / 2) AS w FROM r WHERE rn <= 7)
SELECT vec_id, round(CAST(sum(w * CASE WHEN label % 3 = 0 THEN 1.0 WHEN label % 3 = 1 THEN 0.3 ELSE 0.0 END) / sum(w) AS DOUBLE) * 10000) / 10000 AS score FROM w GROUP BY vec_id""")
def knn_label_vote(spark, sf_dir):
    """Weighted vote of the 7 nearest labelled vectors (liked, passed over, disliked) on each whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    near = scoring.nearest(e.where("vec_id % 50 = 0"), e.where("label is not null"), "vec_id", "embedding", 7)
    worth = F.when(F.col("label") % 3 == 0, 1.0).when(F.col("label") % 3 == 1, 0.3).otherwise(0.0)
    labels = e.select(F.col("vec_id").alias("other"), worth.alias("worth"))
    got = scoring.vote(near.join(labels, "other"), "vec_id")
    return got.withColumn("score", F.round(F.col("score") * 1e4) / 1e4)


@query(f"""WITH {_VEC_SQL}, q AS (SELECT v AS q FROM e WHERE vec_id = 0), s AS (SELECT vec_id, round((({_COS.format(a="v", b="q")}) + 1) / 2 * 1000000) / 1000000 AS rank_score FROM e, q) SELECT vec_id, rank_score FROM s ORDER BY rank_score DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    s = e.crossJoin(F.broadcast(q)).select("vec_id", six((numbers.cosine(F.col("embedding"), F.col("q")) + 1) / 2).alias("rank_score"))
    return s.orderBy(F.desc("rank_score"), "vec_id").limit(20)


@query(f"""WITH {_VEC_SQL}, x AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, unnest(v) AS x FROM e), s AS (SELECT d, avg(x) FILTER (label < 3) AS ml, avg(x) FILTER (label >= 7) AS md, var_pop(x) FILTER (label < 3) AS vl, var_pop(x) FILTER (label >= 7) AS vd FROM x GROUP BY d),
w AS (SELECT *, (ml - md) ** 2 / (vl + vd + 1e-8) AS f FROM s), n AS (SELECT d, ml, md, f / max(f) OVER () AS w FROM w), t AS (SELECT vec_id, sqrt(sum((w * (x - ml)) ** 2)) AS dl, sqrt(sum((w * (x - md)) ** 2)) AS dd FROM x JOIN n USING (d) GROUP BY vec_id)
SELECT vec_id, round(dd / (dl + dd) * 10000) / 10000 AS score FROM t""")
def centroid_score(spark, sf_dir):
    """Nearness to the liked vectors' centre against the disliked ones', along the axes that tell them apart."""
    e = table(spark, sf_dir, "embeddings")
    got = scoring.centroid_scores(e, "vec_id", "embedding", F.col("label") < 3, F.col("label") >= 7)
    return got.withColumn("score", F.round(F.col("score") * 1e4) / 1e4)


@query(f"""WITH {_VEC_SQL}, s AS (SELECT e.vec_id, x.label, max(round({_COS.format(a="e.v", b="x.v")} * 1000000) / 1000000) AS best FROM e JOIN e x ON x.vec_id <> e.vec_id WHERE e.vec_id % 50 = 0 AND x.label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY best DESC, label) AS rn, lead(best) OVER (PARTITION BY vec_id ORDER BY best DESC, label) AS second FROM s) SELECT vec_id, label, best, round((best - second) * 10000) / 10000 AS margin FROM r WHERE rn = 1""")
def nearest_margin(spark, sf_dir):
    """The label of the likest vector, and how far the next label is, for each vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    sims = scoring.nearest(e.where("vec_id % 50 = 0"), e.where("label is not null"), "vec_id", "embedding", 1, by="label").select("vec_id", F.col("by").cast("int").alias("label"), F.col("sim").alias("best"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("best"), "label")
    r = sims.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("best").over(w)).where("rn = 1")
    return r.select("vec_id", "label", "best", (F.round((F.col("best") - F.col("second")) * 1e4) / 1e4).alias("margin"))


@query(f"""WITH {_VEC_SQL}, p AS (SELECT v AS q FROM e WHERE vec_id = 0), s AS (SELECT e.vec_id, x.label, ({_COS.format(a="e.v", b="x.v")} + 1) / 2 AS sim FROM e JOIN e x ON x.vec_id <> e.vec_id WHERE e.vec_id % 50 = 0 AND x.label IN (1, 9)),
g AS (SELECT vec_id, max(sim) FILTER (label = 1) AS love, max(sim) FILTER (label = 9) AS dislike FROM s GROUP BY vec_id), j AS (SELECT e.vec_id, (({_COS.format(a="v", b="q")}) + 1) / 2 AS prof, love, dislike FROM e JOIN g USING (vec_id), p)
SELECT vec_id, round(greatest(0, least(1, prof * 0.7 + love * 0.3 - greatest(0, dislike - prof) * 0.5)) * 10000) / 10000 AS score FROM j""")
def cold_start_score(spark, sf_dir):
    """Similarity to the profile, raised by the likest loved one, lowered where a disliked one is liker than the profile."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    sims = scoring.nearest(asked, e.where("label in (1, 9)"), "vec_id", "embedding", 1, by="label", digits=None)
    half = (F.col("sim") + 1) / 2
    g = sims.groupBy("vec_id").agg(F.max(F.when(F.col("by") == 1, half)).alias("love"), F.max(F.when(F.col("by") == 9, half)).alias("dislike"))
    profile = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    p = asked.crossJoin(F.broadcast(profile)).select("vec_id", ((numbers.cosine(F.col("embedding"), F.col("q")) + 1) / 2).alias("profile"))
    s = scoring.cold_start(F.col("profile"), F.col("love"), F.col("dislike"))
    return p.join(g, "vec_id").select("vec_id", (F.round(s * 1e4) / 1e4).alias("score"))


# labels

_ARENA_SQL = "a AS (SELECT m.model, l.doc_id, l.quality, CASE m.model WHEN 'length' THEN least(1.0, n_chars / 3000.0)::DOUBLE WHEN 'hash' THEN (doc_id * 37 % 100) / 100.0::DOUBLE ELSE 0.9::DOUBLE END AS score FROM labels l JOIN documents d USING (doc_id), (VALUES ('length'), ('hash'), ('always')) m(model))"


def _arena(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scores = F.array(*(F.struct(F.lit(n).alias("model"), s.cast("double").alias("score")) for n, s in (("length", F.least(F.lit(1.0), F.col("n_chars") / 3000.0)), ("hash", (F.col("doc_id") * 37 % 100) / 100.0), ("always", F.lit(0.9)))))
    return rows.select("doc_id", "quality", F.explode(scores).alias("s")).select("doc_id", "quality", "s.model", "s.score")


@query(f"""WITH {_ARENA_SQL}, c AS (SELECT model, count(*) FILTER (score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (score >= 0.5 AND quality = 0) AS fp, count(*) FILTER (score < 0.5 AND quality = 1) AS fn, count(*) FILTER (score < 0.5 AND quality = 0) AS tn,
 avg(score) FILTER (quality = 1) - avg(score) FILTER (quality = 0) AS sep FROM a GROUP BY model)
SELECT model, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn) * 1000000) / 1000000 AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp) * 1000000) / 1000000 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn) * 1000000) / 1000000 END AS recall, round(sep * 1000000) / 1000000 AS separation FROM c""")
def arena_confusion(spark, sf_dir):
    return aggregates.confusion(_arena(spark, sf_dir), "score", "quality", ["model"])


@query(f"WITH {_ARENA_SQL} SELECT model, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END) * 1000000) / 1000000 AS accuracy FROM a GROUP BY model HAVING count(*) >= 5 ORDER BY accuracy DESC, model")
def leaderboard(spark, sf_dir):
    right = ((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int")
    g = _arena(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), six(F.avg(right)).alias("accuracy"))
    return g.where("n >= 5").orderBy(F.desc("accuracy"), "model")


@query(f"""WITH {_ARENA_SQL}, b AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS bar), g AS (SELECT model, bar, count(*) AS told, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS r FROM a JOIN b ON score >= bar GROUP BY ALL)
SELECT model, min(bar) AS bar FROM g WHERE told >= 5 AND r >= 0.86 GROUP BY model""")
def gates(spark, sf_dir):
    """The lowest bar above which a model is right often enough, by one pass of cumulative counts over the bars."""
    return scoring.gates(_arena(spark, sf_dir), ["model"], "score", F.col("quality") == 1, [i / 10 for i in range(1, 10)], 0.86, 5)


# conversations

@query("""WITH s AS (SELECT conv_id, turn, role, regexp_extract(text, '^[^ ]*') AS block FROM conversations WHERE role = 'assistant'), a AS (SELECT s.conv_id, s.turn, s.block, min(r.turn) AS reply FROM s LEFT JOIN conversations r ON r.conv_id = s.conv_id AND r.role = 'user' AND r.turn > s.turn GROUP BY ALL)
SELECT block, count(*) AS sent, count(reply) AS answered, list(reply - turn ORDER BY reply - turn) FILTER (reply IS NOT NULL)[(count(reply) // 2 + 1)] AS middle_wait FROM a GROUP BY block""".replace("list(reply - turn ORDER BY reply - turn) FILTER (reply IS NOT NULL)[(count(reply) // 2 + 1)]", "(list(reply - turn ORDER BY reply - turn) FILTER (reply IS NOT NULL))[count(reply) // 2 + 1]"))
def reply_review(spark, sf_dir):
    """For each opening word: how often sent, answered, and the upper median of turns to the answer. The first reply after
    each message is the next user's turn in the conversation: a window, not a join."""
    c = table(spark, sf_dir, "conversations")
    later = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, Window.unboundedFollowing))
    a = c.withColumn("reply", later).where("role = 'assistant'").select(F.regexp_extract("text", "^[^ ]*", 0).alias("block"), (F.col("reply") - F.col("turn")).alias("wait"))
    g = a.groupBy("block").agg(F.count(F.lit(1)).alias("sent"), F.count("wait").alias("answered"))
    return g.join(aggregates.upper_median(a, "wait", ["block"], "middle_wait").drop("n"), "block", "left")


@query("WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS rn FROM conversations WHERE role = 'user') SELECT conv_id, turn, text FROM r WHERE rn <= 2 AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE turn = 0)")
def unread_last_n(spark, sf_dir):
    """The last two messages of the other side in each conversation, without those reported already."""
    c = table(spark, sf_dir, "conversations")
    last = windows.first_per_key(c.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id"], [F.desc("turn"), "text"], 2)
    return last.join(c.where("turn = 0").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "text")

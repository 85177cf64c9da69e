"""Queries over whole answers: what they hold, what is told of them, in which order they are shown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlane.functions import answers
from offerlane.operators import aggregates, windows
from offerlane.plans.offers import _EUR_SQL, _eur
from offerlane.plans.registry import query
from offerlane.sources.tables import LISTINGS_SQL, OBSERVATIONS_SQL, listings, observations, table

_WITH, _OBS = f"WITH {LISTINGS_SQL}", f"WITH {OBSERVATIONS_SQL}"
n_rows = lambda: F.count(F.lit(1))
six = lambda c: F.round(c * 1e6) / 1e6
_WORDS_SQL = "w AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM documents)"


def _words(spark, sf_dir):
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array_distinct(words).alias("words"))


# counts over answers


@query(f"""{_WITH}, f AS (SELECT platform, 'condition' AS facet, condition AS value, count(*) AS n FROM listings GROUP BY ALL UNION ALL SELECT platform, 'sale_type', sale_type, count(*) FROM listings GROUP BY ALL)
SELECT facet, value, CAST(sum(n) AS BIGINT) AS n, count(*) AS sources FROM f GROUP BY facet, value""")
def facet_merge(spark, sf_dir):
    """The facets of all sources' answers as one: each source counts its own, then their counts are added up."""
    own = aggregates.facets(listings(spark, sf_dir), ["condition", "sale_type"], ["platform"])
    return own.groupBy("facet", "value").agg(F.sum("n").alias("n"), n_rows().alias("sources"))


@query(f"""WITH {_WORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM w), k AS (SELECT source, words FROM r WHERE rn <= 300), s AS (SELECT source, count(*) AS n FROM k GROUP BY source HAVING count(*) >= 5),
x AS (SELECT source, unnest(words) AS word FROM k), c AS (SELECT source, word, count(*) AS carrying FROM x GROUP BY ALL) SELECT source, word, carrying, round(carrying / n * 1000000) / 1000000 AS share FROM c JOIN s USING (source) WHERE carrying / n >= 0.6""")
def model_word_evidence(spark, sf_dir):
    """Words that at least 0.6 of a source's newest 300 texts carry, where there are five of them."""
    newest = windows.first_per_key(_words(spark, sf_dir), ["source"], [F.desc("doc_id")], 300)
    share = aggregates.share_carrying(newest.withColumnRenamed("words", "_w"), F.col("_w"), ["source"])
    enough = newest.groupBy("source").agg(n_rows().alias("n")).where("n >= 5").select("source")
    return share.join(F.broadcast(enough), "source").where("share >= 0.6").select("source", F.col("token").alias("word"), F.col("n_rows").alias("carrying"), six(F.col("share")).alias("share"))


@query(f"""WITH {_WORDS_SQL}, a AS (SELECT doc_id, source, words, count(*) OVER (PARTITION BY source) - 1 AS others FROM w), c AS (SELECT source, count(*) FILTER (list_contains(words, 'the')) AS t, count(*) FILTER (list_contains(words, 'der')) AS d FROM w GROUP BY source),
p AS (SELECT doc_id, unnest(['the', 'der']) AS word, unnest([t, d]) - CASE WHEN list_contains(words, unnest(['the', 'der'])) THEN 1 ELSE 0 END AS carriers, list_contains(words, unnest(['the', 'der'])) AS carries, others FROM a JOIN c USING (source))
SELECT doc_id, word FROM p WHERE NOT carries AND others >= 2 AND carriers >= 2 AND carriers / others >= 0.6""")
def implied_words(spark, sf_dir):
    """Of the words asked for, those a text doesn't carry but its source's other texts imply: two at least, 0.6 of them."""
    asked = ["the", "der"]
    rows = _words(spark, sf_dir).select("doc_id", "source", *(F.array_contains("words", w).alias(w) for w in asked))
    sums = rows.groupBy("source").agg(n_rows().alias("n"), *(F.count_if(w).alias(f"n_{w}") for w in asked))
    said = F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(w).alias("carries"), F.col(f"n_{w}").alias("carriers")) for w in asked)))
    told = rows.join(F.broadcast(sums), "source").select("doc_id", "n", said.alias("s")).where("not s.carries")  # a row for each source
    return told.where((F.col("n") > 2) & (F.col("s.carriers") >= 2) & (F.col("s.carriers") / (F.col("n") - 1) >= 0.6)).select("doc_id", "s.word")


@query(f"WITH {_WORDS_SQL}, x AS (SELECT source, unnest(words) AS term FROM w) SELECT term, count(DISTINCT source) AS searches FROM x GROUP BY term HAVING count(DISTINCT source) >= 2")
def searches_offering(spark, sf_dir):
    """In how many searches (here: sources) a term was offered, each counted once however often."""
    pairs = _words(spark, sf_dir).select("source", F.explode("words").alias("term")).distinct()
    return pairs.groupBy("term").agg(F.count("source").alias("searches")).where("searches >= 2")


@query("""WITH t AS (SELECT regexp_extract(text, '^[^ ]*') AS term, role = 'user' AS searched, turn AS added, conv_id FROM conversations WHERE text IS NOT NULL), r AS (SELECT lower(term) AS name, term, searched, added, row_number() OVER (PARTITION BY lower(term) ORDER BY searched DESC, added DESC, conv_id, term) AS rn FROM t)
SELECT name, term, searched, added FROM r WHERE rn = 1""")
def suggested_terms(spark, sf_dir):
    """One suggestion for each word whatever its case: a searched one before others, then the newest."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    t = c.select(F.regexp_extract("text", "^[^ ]*", 0).alias("term"), (F.col("role") == "user").alias("searched"), F.col("turn").alias("added"), "conv_id").withColumn("name", F.lower("term"))
    return windows.first_per_key(t, ["name"], [F.desc("searched"), F.desc("added"), "conv_id", "term"]).select("name", "term", "searched", "added")


@query(f"{_WITH}, c AS (SELECT part, power_kw, seller FROM listings), k AS (SELECT seller, power_kw, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seller ORDER BY n DESC, power_kw) AS rn FROM k) SELECT seller, power_kw, n FROM r WHERE rn = 1")
def most_frequent(spark, sf_dir):
    """Each seller's most frequent power, the smallest of equally frequent ones: counted first, so only distinct values meet."""
    counts = listings(spark, sf_dir).groupBy("seller", "power_kw").agg(n_rows().alias("n"))
    return windows.first_per_key(counts, ["seller"], [F.desc("n"), "power_kw"]).select("seller", "power_kw", "n")


_REPORT_SQL = "r AS (SELECT doc_id, quality, least(1.0, n_chars / 3000.0)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("score"))


@query(f"""WITH {_REPORT_SQL} SELECT quality, count(*) AS n, round(avg(score) * 1000000) / 1000000 AS mean, list_sort(list(round(score * 1000000) / 1000000))[count(*) // 2 + 1] AS middle,
count(*) FILTER (score >= 0.6) AS told_good, count(*) FILTER (score < 0.6 AND score >= 0.3) AS unsure, count(*) FILTER (score < 0.3) AS told_bad FROM r GROUP BY quality""")
def evaluation_report(spark, sf_dir):
    """Scores of each class: mean, upper median, and how many fall into each verdict."""
    r = _report(spark, sf_dir).withColumn("score6", six(F.col("score")))
    s = F.col("score")
    g = r.groupBy("quality").agg(n_rows().alias("n"), six(F.avg("score")).alias("mean"), F.count_if(s >= 0.6).alias("told_good"), F.count_if((s < 0.6) & (s >= 0.3)).alias("unsure"), F.count_if(s < 0.3).alias("told_bad"))
    return g.join(aggregates.upper_median(r, "score6", ["quality"], "middle").drop("n"), "quality").select("quality", "n", "mean", "middle", "told_good", "unsure", "told_bad")


_CONFIGS = [("length", 1.0, 0.0), ("mostly length", 0.8, 0.2), ("even", 0.5, 0.5), ("mostly id", 0.2, 0.8), ("id", 0.0, 1.0)]


@query(f"""WITH {_REPORT_SQL}, c(config, a, b) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in _CONFIGS)}), s AS (SELECT config, quality, a * score + b * (doc_id * 37 % 100) / 100.0::DOUBLE AS s FROM r, c)
SELECT config, count(*) FILTER (s >= 0.6 AND quality = 1) AS tp, count(*) FILTER (s >= 0.6 AND quality = 0) AS fp, count(*) FILTER (s < 0.6 AND quality = 1) AS fn, round(avg(CASE WHEN (s >= 0.6) = (quality = 1) THEN 1.0 ELSE 0.0 END) * 1000000) / 1000000 AS accuracy FROM s GROUP BY config""")
def weight_configs(spark, sf_dir):
    """How each of a few weightings of two signals would have judged the labelled rows; rows are read once."""
    r = _report(spark, sf_dir)
    other = (F.col("doc_id") * 37 % 100) / 100.0
    said = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), (F.lit(a) * F.col("score") + F.lit(b) * other).alias("s")) for n, a, b in _CONFIGS)))
    good, true = F.col("s") >= 0.6, F.col("quality") == 1
    s = r.select("quality", said.alias("c")).select("quality", "c.config", "c.s").groupBy("config")
    return s.agg(F.count_if(good & true).alias("tp"), F.count_if(good & ~true).alias("fp"), F.count_if(~good & true).alias("fn"), six(F.avg((good == true).cast("int"))).alias("accuracy"))


@query(f"{_WITH} SELECT buyer, min(country) AS country, max(mileage_km) AS most_km, min(first_year) AS first_year, max(first_year) AS last_year, count(*) AS n FROM listings GROUP BY buyer")
def entity_rollup(spark, sf_dir):
    """One row for each entity from all that was seen of it."""
    return listings(spark, sf_dir).groupBy("buyer").agg(F.min("country").alias("country"), F.max("mileage_km").alias("most_km"), F.min("first_year").alias("first_year"), F.max("first_year").alias("last_year"), n_rows().alias("n"))


@query(f"""{_WITH}, b AS (SELECT condition AS family, CAST(floor(mileage_km / 20000) AS BIGINT) AS bin, count(*) AS exposed, count(*) FILTER (sold) AS ended FROM listings WHERE mileage_km IS NOT NULL AND condition IS NOT NULL GROUP BY ALL),
f AS (SELECT bin, sum(exposed) AS e, sum(ended) AS d FROM b GROUP BY bin), s AS (SELECT family, sum(exposed) AS size FROM b GROUP BY family)
SELECT family, bin, exposed, ended, CASE WHEN size >= 300 THEN round(ended / exposed * 1000000) / 1000000 ELSE round(d / e * 1000000) / 1000000 END AS hazard, size >= 300 AS own FROM b JOIN f USING (bin) JOIN s USING (family)""")
def family_hazard(spark, sf_dir):
    """The share that ends in each bin: a family's own where it has 300 rows, else the whole fleet's."""
    rows = listings(spark, sf_dir).where("mileage_km is not null and condition is not null").select(F.col("condition").alias("family"), F.floor(F.col("mileage_km") / 20000).alias("bin"), "sold")
    own = rows.groupBy("family", "bin").agg(n_rows().alias("exposed"), F.count_if("sold").alias("ended"))
    fleet = own.groupBy("bin").agg((F.sum("ended") / F.sum("exposed")).alias("fleet"))
    size = own.groupBy("family").agg(F.sum("exposed").alias("size"))
    both = own.join(fleet, "bin").join(size, "family")
    enough = F.col("size") >= 300
    return both.select("family", "bin", "exposed", "ended", six(F.when(enough, F.col("ended") / F.col("exposed")).otherwise(F.col("fleet"))).alias("hazard"), enough.alias("own"))


@query("""SELECT event_type, count(*) AS requests, count(*) FILTER (value > 20) AS blocks, round(count(*) FILTER (value > 20) / count(*) * 1000000) / 1000000 AS block_rate, max(ts) AS last_seen, max(ts) FILTER (value > 20) AS last_block FROM events GROUP BY event_type""")
def source_health(spark, sf_dir):
    """Requests, blocks and their share for each source, and when each was last."""
    blocked = F.col("value") > 20
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(n_rows().alias("requests"), F.count_if(blocked).alias("blocks"), F.max("ts").alias("last_seen"), F.max(F.when(blocked, F.col("ts"))).alias("last_block"))
    return g.withColumn("block_rate", six(F.col("blocks") / F.col("requests")))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS liked, count(*) FILTER (quality = 0) AS disliked, count(*) FILTER (toxic = 1) AS refused, count(DISTINCT doc_id) AS documents FROM labels")
def feedback_stats(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(n_rows().alias("n"), F.count_if(F.col("quality") == 1).alias("liked"), F.count_if(F.col("quality") == 0).alias("disliked"), F.count_if(F.col("toxic") == 1).alias("refused"), F.count_distinct("doc_id").alias("documents"))


@query(f"""{_WITH}, u AS (SELECT part, ({_EUR_SQL}) AS cents FROM listings WHERE condition = 'NEW' AND NOT sold UNION ALL SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) FROM part) SELECT part, min(cents) AS cents FROM u GROUP BY part""")
def cheapest_new(spark, sf_dir):
    """What a thing costs new at least: its offers and the catalogue's price."""
    offers = listings(spark, sf_dir).where("condition = 'NEW' and not sold").select("part", _eur().alias("cents"))
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return offers.unionByName(catalogue).groupBy("part").agg(F.min("cents").alias("cents"))


@query("WITH u AS (SELECT conv_id, count(*) FILTER (role = 'user' AND turn > coalesce(a, -1)) AS unread FROM conversations LEFT JOIN (SELECT conv_id, max(turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id) GROUP BY conv_id) SELECT CAST(sum(unread) AS BIGINT) AS unread, count(*) FILTER (unread > 0) AS conversations FROM u")
def unread_total(spark, sf_dir):
    """Messages after our last one, over all conversations."""
    c = table(spark, sf_dir, "conversations")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    u = c.withColumn("last", last).groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & (F.col("turn") > F.coalesce("last", F.lit(-1)))).alias("unread"))
    return u.agg(F.sum("unread").alias("unread"), F.count_if(F.col("unread") > 0).alias("conversations"))


# what stays


@query(f"{_WITH} SELECT id, title, price_cents, coalesce(CASE WHEN sale_type = 'AUCTION' THEN sold_at END, listed_at) AS dated FROM listings WHERE sold AND contains(lower(title), 'widget') ORDER BY dated DESC, id LIMIT 200")
def sold_history(spark, sf_dir):
    """Sold offers whose title holds the words, newest first by the date of sale, or of reading where none is stated."""
    at = F.coalesce(F.when(F.col("sale_type") == "AUCTION", F.col("sold_at")), F.col("listed_at"))
    return listings(spark, sf_dir).where(F.col("sold") & F.contains(F.lower("title"), F.lit("widget"))).select("id", "title", "price_cents", at.alias("dated")).orderBy(F.desc("dated"), "id").limit(200)


@query(f"""{_WITH}, s AS (SELECT id, CAST(power_kw // 10 AS INTEGER) AS low, CASE WHEN part % 4 <> 0 THEN CAST(power_kw // 10 + part % 3 AS INTEGER) END AS high FROM listings)
SELECT id, low, high FROM s WHERE low IS NULL OR 2 BETWEEN low AND coalesce(high, low) OR 4 BETWEEN low AND coalesce(high, low)""")
def size_overlap(spark, sf_dir):
    """Offers one of whose possible sizes is wanted; an unstated size stays, and an unstated upper end is the lower one."""
    low = F.expr("power_kw div 10").cast("int")
    high = F.when(F.col("part") % 4 != 0, (low + F.col("part") % 3).cast("int"))
    rows = listings(spark, sf_dir).select("id", low.alias("low"), high.alias("high"))
    return rows.where(answers.may_be(F.col("low"), F.col("high"), [2, 4]))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'the') AND contains(lower(coalesce(text, '')), 'license')")
def all_words(spark, sf_dir):
    """Texts that hold each of the words asked for."""
    return table(spark, sf_dir, "documents").where(answers.holds_all(F.col("text"), "the License")).select("doc_id")


@query(f"""{_WITH}, e AS (SELECT *, ({_EUR_SQL}) AS cents FROM listings), j AS (SELECT id, cents, p_retailprice * 100 AS new_cents, first_year, mileage_km FROM e JOIN part ON part = p_partkey)
SELECT id, cents, CASE WHEN first_year >= 1998 AND mileage_km < 20000 AND cents < new_cents * 0.4 THEN 'near new' WHEN first_year >= 1996 AND cents < new_cents * 0.1 THEN 'young' END AS too_cheap FROM j""")
def reference_floor(spark, sf_dir):
    """Offers priced under a share of what the thing costs new: 0.4 of a near-new one, 0.1 of a young one."""
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_retailprice") * 100).alias("new_cents"))
    rows = listings(spark, sf_dir).withColumn("cents", _eur()).join(new, "part")
    c = F.col
    said = F.when((c("first_year") >= 1998) & (c("mileage_km") < 20000) & (c("cents") < c("new_cents") * 0.4), "near new").when((c("first_year") >= 1996) & (c("cents") < c("new_cents") * 0.1), "young")
    return rows.select("id", "cents", said.alias("too_cheap"))


_BLOCKED = ["red ring", "steel bolt", "large 7"]


@query(f"{_WITH}, n AS (SELECT id, concat(' ', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM listings) SELECT id FROM n WHERE " + " AND ".join(f"NOT contains(t, ' {b} ')" for b in _BLOCKED))
def reader_blocked_terms(spark, sf_dir):
    """Offers whose title has none of the reader's phrases as whole words."""
    return listings(spark, sf_dir).where(~answers.has_phrase(F.col("title"), _BLOCKED)).select("id")


@query(f"""{_WITH}, t AS (SELECT id, price_cents, CAST(contains(concat(' ', lower(title), ' '), ' red ') AS INTEGER) + CAST(contains(concat(' ', lower(title), ' '), ' ring ') AS INTEGER) + CAST(contains(concat(' ', lower(title), ' '), ' large ') AS INTEGER) AS carried FROM listings)
SELECT id, carried, carried <= 1 AS off_query FROM t ORDER BY off_query, price_cents, id LIMIT 500""")
def off_query_last(spark, sf_dir):
    """Offers that carry none of the words, or only one of three, stay but come last."""
    words = F.split(F.lower("title"), " ")
    carried = sum((F.array_contains(words, w).cast("int") for w in ("ring", "large")), F.array_contains(words, "red").cast("int"))
    rows = listings(spark, sf_dir).select("id", "price_cents", carried.alias("carried")).withColumn("off_query", F.col("carried") <= 1)
    return rows.orderBy("off_query", "price_cents", "id").limit(500).drop("price_cents")


@query(f"""{_WITH}, t AS (SELECT platform, trim(lower(title)) AS title, count(*) AS n FROM listings GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY platform) AS of, row_number() OVER (PARTITION BY platform ORDER BY n DESC, title) AS rn FROM t)
SELECT platform, title, n, CAST(of AS BIGINT) AS of, of >= 5 AND n >= 5 AND n / of >= 0.5 AND NOT contains(title, 'ring') AS misread FROM s WHERE rn = 1""")
def repeated_title(spark, sf_dir):
    """Each source's most frequent title, and whether it tells of a reader gone wrong: five rows, half of all, off the query."""
    counts = listings(spark, sf_dir).groupBy("platform", F.trim(F.lower("title")).alias("title")).agg(n_rows().alias("n"))
    top = windows.first_per_key(counts, ["platform"], [F.desc("n"), "title"]).join(counts.groupBy("platform").agg(F.sum("n").alias("of")), "platform")
    wrong = (F.col("of") >= 5) & (F.col("n") >= 5) & (F.col("n") / F.col("of") >= 0.5) & ~F.contains("title", F.lit("ring"))
    return top.select("platform", "title", "n", "of", wrong.alias("misread"))


@query(f"""{_WITH}, p AS (SELECT *, ({_EUR_SQL}) AS cents FROM listings WHERE NOT sold) SELECT id, cents FROM p WHERE cents BETWEEN 100000 AND 2000000 AND (condition IS NULL OR condition <> 'NEW') AND condition IS DISTINCT FROM 'PARTS_ONLY'
AND (contains(lower(title), 'ring') OR contains(lower(title), 'bolt')) AND NOT contains(lower(title), 'blue')""")
def alert_subfilter(spark, sf_dir):
    """Which offers an alert is about: its band of prices, not new, not broken, one of its words, none of those it excludes."""
    rows = listings(spark, sf_dir).where("not sold").withColumn("cents", _eur())
    rule = answers.AlertRule(1000, 20000, "used", ("ring", "bolt"), ("blue",))
    return rows.where(answers.matches_rule(rule)).select("id", "cents")


@query(f"{_WITH} SELECT id, sale_type, sale_type IS DISTINCT FROM 'AUCTION' OR coalesce(sold_at <= TIMESTAMP '1996-01-01' + INTERVAL 360 MINUTE, false) AS interrupts FROM listings WHERE NOT sold")
def auction_urgency(spark, sf_dir):
    """An auction is worth an alert only if it ends before the next run."""
    ends = F.coalesce(F.col("sold_at") <= F.lit("1996-01-01 06:00:00").cast("timestamp_ntz"), F.lit(False))
    return listings(spark, sf_dir).where("not sold").select("id", "sale_type", (~F.col("sale_type").eqNullSafe("AUCTION") | ends).alias("interrupts"))


@query(f"""{_WITH}, p AS (SELECT id, platform, listed_at, ({_EUR_SQL}) AS cents FROM listings WHERE condition IS DISTINCT FROM 'PARTS_ONLY'), b AS (SELECT platform, min(cents) AS best FROM p WHERE listed_at < TIMESTAMP '1995-01-01' GROUP BY platform)
SELECT id, cents, best, cents < best AS beats FROM p LEFT JOIN b USING (platform) WHERE listed_at >= TIMESTAMP '1995-01-01'""")
def beats_learned_best(spark, sf_dir):
    """A rule learns the cheapest price up to a day; later offers are told where they cost less."""
    until = F.lit("1995-01-01").cast("timestamp_ntz")
    p = listings(spark, sf_dir).where(~F.col("condition").eqNullSafe("PARTS_ONLY")).select("id", "platform", "listed_at", _eur().alias("cents"))
    best = p.where(F.col("listed_at") < until).groupBy("platform").agg(F.min("cents").alias("best"))
    later = p.where(F.col("listed_at") >= until).join(F.broadcast(best), "platform", "left")  # a row for each market
    return later.select("id", "cents", "best", (F.col("cents") < F.col("best")).alias("beats"))


@query(f"{_WITH} SELECT id, platform, country FROM listings WHERE platform IN ('ASIA') OR country IN ('GERMANY', 'FRANCE')")
def market_or_country(spark, sf_dir):
    """Offers of the chosen markets or countries; nothing chosen would be all."""
    return listings(spark, sf_dir).where(answers.chosen({"platform": ["ASIA"], "country": ["GERMANY", "FRANCE"]})).select("id", "platform", "country")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' | ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR))), '#1')")
def catalogue_search(spark, sf_dir):
    """Catalogue rows with the words in any of their fields."""
    fields = [F.col(c).cast("string") for c in ("p_name", "p_brand", "p_type", "p_size", "p_partkey")]
    found = F.exists(F.array(*fields), lambda v: F.contains(F.lower(v), F.lit("#1")))
    return table(spark, sf_dir, "part").where(found).select("p_partkey", "p_name")


@query(f"WITH {_REPORT_SQL} SELECT doc_id, round(score * 1000000) / 1000000 AS score FROM r WHERE score < 0.3 ORDER BY doc_id DESC LIMIT 50")
def rejected_newest(spark, sf_dir):
    """The newest rows under the bar."""
    return _report(spark, sf_dir).where("score < 0.3").orderBy(F.desc("doc_id")).limit(50).select("doc_id", six(F.col("score")).alias("score"))


@query("""WITH l AS (SELECT conv_id, max(turn) AS turns, max_by(role, turn) AS last_role, bool_or(text IS NULL OR trim(text) = '') AS blank FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN blank THEN 'no text' WHEN last_role = 'assistant' THEN 'not answered yet' WHEN turns >= 8 THEN 'too long' END AS unreachable FROM l""")
def send_guard(spark, sf_dir):
    """Why nothing is sent in a conversation, or null; no row is lost."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.max_by("role", "turn").alias("last"), F.bool_or(blank).alias("blank"))
    return c.select("conv_id", F.when(F.col("blank"), "no text").when(F.col("last") == "assistant", "not answered yet").when(F.col("turns") >= 8, "too long").alias("unreachable"))


# orders


@query(f"""{_WITH}, s AS (SELECT id, part % 7 = 0 AS off_query, round(price_cents / power_kw * 1000) / 1000 AS per_unit FROM listings WHERE power_kw > 0 AND NOT sold),
r AS (SELECT id, row_number() OVER (ORDER BY off_query, per_unit, id) AS by_unit FROM s) SELECT id, CAST(by_unit AS INTEGER) AS by_unit FROM r WHERE by_unit <= 50""")
def sort_per_unit(spark, sf_dir):
    """The fifty cheapest by unit, off-query ones last, with their places: only those fifty are numbered."""
    unit = F.round(F.col("price_cents") / F.col("power_kw") * 1000) / 1000
    s = listings(spark, sf_dir).where("power_kw > 0 and not sold").select("id", (F.col("part") % 7 == 0).alias("off"), unit.alias("unit"))
    order = ["off", "unit", "id"]
    return s.orderBy(*order).limit(50).withColumn("by_unit", F.row_number().over(Window.orderBy(*order))).select("id", "by_unit")


@query(f"{_WITH} SELECT id, 200000 - mileage_km AS life FROM listings WHERE NOT sold ORDER BY part % 7 = 0, life DESC NULLS LAST, id LIMIT 50")
def sort_longest_life(spark, sf_dir):
    life = (F.lit(200000) - F.col("mileage_km")).alias("life")
    s = listings(spark, sf_dir).where("not sold").select("id", "part", life)
    return s.orderBy(F.col("part") % 7 == 0, F.col("life").desc_nulls_last(), "id").limit(50).select("id", "life")


@query(f"{_WITH} SELECT platform, bool_or(mileage_km IS NOT NULL) AS longest_life, bool_or(first_year IS NOT NULL AND power_kw IS NOT NULL) AS cost_to_own, bool_or(sale_type = 'AUCTION') AS ending_soonest FROM listings GROUP BY platform")
def offered_sorts(spark, sf_dir):
    """Which orders an answer offers: those its rows have data for."""
    some = lambda c: F.bool_or(c)
    return listings(spark, sf_dir).groupBy("platform").agg(some(F.col("mileage_km").isNotNull()).alias("longest_life"), some(F.col("first_year").isNotNull() & F.col("power_kw").isNotNull()).alias("cost_to_own"), some(F.col("sale_type") == "AUCTION").alias("ending_soonest"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT source, CAST((rn - 1) // 50 AS BIGINT) AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY source, (rn - 1) // 50")
def batches_of_fifty(spark, sf_dir):
    """Rows of a source in calls of fifty, in order."""
    rows = windows.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "place")
    rows = rows.select("doc_id", "source", F.floor(F.col("place") / 50).alias("batch"))
    return rows.groupBy("source", "batch").agg(n_rows().alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""{_OBS}, s AS (SELECT offer, search, max(price_cents) AS score FROM observations GROUP BY ALL), t AS (SELECT DISTINCT offer FROM observations WHERE search = 'signup') SELECT search, offer, score FROM s WHERE score >= 3000 AND offer NOT IN (SELECT offer FROM t) OR score >= 3000 AND search = 'signup' ORDER BY score DESC, offer, search LIMIT 100""")
def alerts_in_order(spark, sf_dir):
    """Offers over the floor that weren't told before, best first."""
    s = observations(spark, sf_dir).groupBy("offer", "search").agg(F.max("price_cents").alias("score")).where("score >= 3000")
    told = observations(spark, sf_dir).where("search = 'signup'").select("offer").distinct()
    fresh = s.where("search <> 'signup'").join(told, "offer", "left_anti").unionByName(s.where("search = 'signup'"))
    return fresh.orderBy(F.desc("score"), "offer", "search").limit(100).select("search", "offer", "score")


@query(f"{_WITH}, c AS (SELECT min(id) AS current FROM listings WHERE part = 7) SELECT id, price_cents FROM listings, c WHERE NOT sold ORDER BY id <> current, price_cents DESC, id LIMIT 100")
def pinned_first(spark, sf_dir):
    """The row at hand first, then the others by score."""
    all_ = listings(spark, sf_dir)
    current = all_.where("part = 7").agg(F.min("id").alias("current"))  # one row
    return all_.where("not sold").crossJoin(F.broadcast(current)).orderBy(F.col("id") != F.col("current"), F.desc("price_cents"), "id").limit(100).select("id", "price_cents")


@query("WITH a AS (SELECT * FROM pages ORDER BY page_id DESC LIMIT 40) SELECT page_id, url FROM a WHERE contains(url, 'example.com') ORDER BY page_id DESC LIMIT 20")
def over_fetch(spark, sf_dir):
    """The newest forty are read, those that fit of them stay, twenty at most: fewer than there are may come back."""
    newest = table(spark, sf_dir, "pages").orderBy(F.desc("page_id")).limit(40)
    return newest.where(F.contains("url", F.lit("example.com"))).orderBy(F.desc("page_id")).limit(20).select("page_id", "url")


# within an order of events


@query("""WITH c AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_id, n, n <= 15 AND (before IS NULL OR ts - before >= INTERVAL 8 SECONDS) AS admitted FROM c""")
def caller_rate(spark, sf_dir):
    """Whether a caller keeps to the rate: so many within the time, and a least gap to the call before."""
    counted = windows.rolling_count(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = counted.withColumn("before", before)
    return rows.select("event_id", "n", ((F.col("n") <= 15) & (F.col("before").isNull() | (micros("ts") - micros("before") >= 8_000_000))).alias("admitted"))


@query(f"""{_OBS}, r AS (SELECT search, offer, price_cents, row_number() OVER (PARTITION BY search, offer ORDER BY seen, event_id) AS rn, max(seen) OVER (PARTITION BY search, offer) AS last_seen FROM observations)
SELECT search, offer, price_cents AS first_price, last_seen FROM r WHERE rn = 1""")
def insert_once(spark, sf_dir):
    """An archive keeps what it first saw of an offer; later looks only renew the date."""
    first = F.min_by("price_cents", F.struct("seen", "event_id")).alias("first_price")
    return observations(spark, sf_dir).groupBy("search", "offer").agg(first, F.max("seen").alias("last_seen"))


@query(f"""{_OBS}, l AS (SELECT search, offer, max(seen) AS stored, max_by(price_cents, struct_pack(seen, event_id)) AS price_cents FROM observations GROUP BY ALL), n AS (SELECT max(seen) AS now FROM observations)
SELECT search, offer, price_cents FROM l, n WHERE stored >= now - INTERVAL 10 DAY AND NOT (search = 'error' AND stored < TIMESTAMP '2024-01-25')""")
def detail_cache(spark, sf_dir):
    """What a cache still answers: rows young enough, and of one source only those read since its reader changed."""
    o = observations(spark, sf_dir)
    last = o.groupBy("search", "offer").agg(F.max("seen").alias("stored"), F.max_by("price_cents", F.struct("seen", "event_id")).alias("price_cents"))
    now = o.agg(F.max("seen").alias("now"))  # one row
    fresh = (F.col("stored") >= F.col("now") - F.expr("interval 10 days")) & ~((F.col("search") == "error") & (F.col("stored") < F.lit("2024-01-25").cast("timestamp_ntz")))
    return last.crossJoin(F.broadcast(now)).where(fresh).select("search", "offer", "price_cents")


@query(f"{_WITH} SELECT id, sold_at - INTERVAL 30 MINUTE AS due FROM listings WHERE sale_type = 'AUCTION' AND NOT sold AND sold_at - INTERVAL 30 MINUTE <= TIMESTAMP '1998-06-01' AND sold_at > TIMESTAMP '1998-06-01' - INTERVAL 20 DAY")
def reminders_due(spark, sf_dir):
    """Auctions whose reminder is due at a moment and that haven't ended long before."""
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    due = F.col("sold_at") - F.expr("interval 30 minutes")
    return listings(spark, sf_dir).where((F.col("sale_type") == "AUCTION") & ~F.col("sold") & (due <= now) & (F.col("sold_at") > now - F.expr("interval 20 days"))).select("id", due.alias("due"))


@query(f"""{_OBS}, d AS (SELECT DISTINCT search, offer, CAST(seen AS DATE) AS day FROM observations), a AS (SELECT DISTINCT search, day FROM d), l AS (SELECT search, offer, max(day) AS last FROM d GROUP BY ALL), e AS (SELECT search, max(day) AS newest FROM a GROUP BY search)
SELECT search, offer, last, newest FROM l JOIN e USING (search) WHERE last < newest AND search <> 'error'""")
def gone_but_for_silent_sources(spark, sf_dir):
    """Offers that a search's newest run no longer has. A source that gave no answer tells nothing of its offers."""
    silent = ["error"]
    l = observations(spark, sf_dir).groupBy("search", "offer").agg(F.max(F.col("seen").cast("date")).alias("last")).where(~F.col("search").isin(silent))
    newest = l.groupBy("search").agg(F.max("last").alias("newest"))
    return l.join(newest, "search").where("last < newest").select("search", "offer", "last", "newest")

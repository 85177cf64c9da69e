"""Lookups with fallbacks, what texts say, and small calculations on single rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlane.functions import fit, numbers, sale, text
from offerlane.operators import lookups, windows
from offerlane.plans.offers import _EUR_SQL, _eur
from offerlane.plans.registry import query
from offerlane.sources.tables import LISTINGS_SQL, OBSERVATIONS_SQL, listings, observations, table

_WITH, _OBS = f"WITH {LISTINGS_SQL}", f"WITH {OBSERVATIONS_SQL}"
n_rows = lambda: F.count(F.lit(1))
six = lambda c: F.round(c * 1e6) / 1e6


# lookups


@query("""WITH z AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), a AS (SELECT s_nationkey AS k, min(s_suppkey) AS by_nation FROM supplier GROUP BY 1), b AS (SELECT n_regionkey AS r, min(s_suppkey) AS by_region FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT min(s_suppkey) AS anywhere FROM supplier)
SELECT c_custkey, coalesce(by_nation, by_region, anywhere) AS supplier, CASE WHEN by_nation IS NOT NULL THEN 'nation' WHEN by_region IS NOT NULL THEN 'region' ELSE 'anywhere' END AS found_by
FROM z JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON k = c_nationkey LEFT JOIN b ON r = n_regionkey, c""")
def lookup_chain(spark, sf_dir):
    """The place of a customer by the closest key that is known: nation, then region, then any."""
    t = lambda n: table(spark, sf_dir, n)
    nation = F.broadcast(t("nation").select("n_nationkey", "n_regionkey"))  # a country each
    rows = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    known = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    return lookups.first_known(rows, known, ["n_nationkey", "n_regionkey"], ["nation", "region", "anywhere"], "s_suppkey", "supplier").select("c_custkey", "supplier", "found_by")


@query(f"""{_WITH}, m AS (SELECT DISTINCT part // 10 AS family, power_kw AS kw FROM listings WHERE sold), o AS (SELECT DISTINCT id, part // 10 AS family, power_kw + 1 AS kw FROM listings WHERE NOT sold),
n AS (SELECT o.id, o.kw, min(m.kw) AS near FROM o LEFT JOIN m ON m.family = o.family AND abs(m.kw - o.kw) <= 2 GROUP BY ALL), s AS (SELECT family, min(kw) AS any_kw FROM m GROUP BY family)
SELECT n.id, CAST(coalesce(near, any_kw) AS INTEGER) AS version_kw, near IS NOT NULL AS by_power FROM n JOIN o USING (id) LEFT JOIN s USING (family)""")
def version_or_sibling(spark, sf_dir):
    """A model's version by power, two kW more or less; else the family's smallest."""
    family = F.expr("part div 10").alias("family")
    all_ = listings(spark, sf_dir)
    known = all_.where("sold").select(family, F.col("power_kw").alias("version_kw")).distinct()
    rows = all_.where("not sold").select("id", family, (F.col("power_kw") + 1).alias("kw"))
    near = known.select("family", F.explode(F.sequence(F.col("version_kw") - 2, F.col("version_kw") + 2)).alias("kw"), "version_kw").groupBy("family", "kw").agg(F.min("version_kw").alias("near"))
    sibling = known.groupBy("family").agg(F.min("version_kw").alias("any_kw"))
    found = rows.join(near, ["family", "kw"], "left").join(sibling, "family", "left")
    return found.select("id", F.coalesce("near", "any_kw").alias("version_kw"), F.col("near").isNotNull().alias("by_power"))


@query(f"""{_WITH}, g AS (SELECT part, min(id) AS first_id FROM listings GROUP BY part), f AS (SELECT l.part, l.seller, l.place FROM listings l JOIN g ON l.id = g.first_id)
SELECT l.id, l.seller <> f.seller OR abs(l.place - f.place) > 3 AS apart FROM listings l JOIN f USING (part)""")
def same_photo_apart(spark, sf_dir):
    """Whether an offer with the first one's photo (here: of its part) is another seller's, or far away."""
    all_ = listings(spark, sf_dir)
    first = all_.groupBy("part").agg(F.min_by(F.struct("seller", "place"), "id").alias("f"))
    apart = (F.col("seller") != F.col("f.seller")) | (F.abs(F.col("place") - F.col("f.place")) > 3)
    return all_.join(first, "part").select("id", apart.alias("apart"))


_TITLE_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TITLE_WORDS_SQL.format("text")} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, least(len(w), len(b)) >= 3 AND len(list_intersect(w, b)) >= least(len(w), len(b)) * 0.8 AS same_words FROM p WHERE b IS NOT NULL""")
def same_words(spark, sf_dir):
    """Whether most of the shorter text's words stand in the one before it: three words at least, 0.8 of them."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("b", before).where("b is not null")
    return rows.select("conv_id", "turn", text.share_words(F.col("w"), F.col("b")).alias("same_words"))


@query(f"""{_OBS}, r AS (SELECT offer, seen AS learned_at, price_cents AS learned FROM observations WHERE search = 'signup'), k AS (SELECT event_id, offer, seen, price_cents FROM observations WHERE search = 'purchase')
SELECT event_id, price_cents, learned, learned_at FROM k ASOF LEFT JOIN r ON k.offer = r.offer AND k.seen >= r.learned_at""")
def learned_at_the_time(spark, sf_dir):
    """What a rule had learned of an offer when it was seen: the last state up to then."""
    o = observations(spark, sf_dir)
    rule = o.where("search = 'signup'").select("offer", F.col("seen").alias("learned_at"), F.col("price_cents").alias("learned"))
    return lookups.as_of(o.where("search = 'purchase'"), rule, ["offer"], "seen", "learned_at").select("event_id", "price_cents", "learned", "learned_at")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS site, regexp_replace(url, '[?#].*$', '') AS product FROM pages), u AS (SELECT site, product, min(page_id) AS page_id FROM p GROUP BY ALL), k AS (SELECT site, count(*) AS products FROM u GROUP BY site)
SELECT p.page_id, k.products - 1 AS others FROM p JOIN k USING (site)""")
def basket_candidates(spark, sf_dir):
    """How many other products the same shop offers, each address once: counted by shop, without pairs."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1).alias("site"), F.regexp_replace("url", "[?#].*$", "").alias("product"))
    shops = p.select("site", "product").distinct().groupBy("site").agg((n_rows() - 1).alias("others"))
    return p.join(shops, "site").select("page_id", "others")


@query(f"""{_WITH}, j AS (SELECT doc_id, count(*) AS judged, max(quality) AS best FROM labels GROUP BY doc_id) SELECT doc_id, coalesce(judged, 0) AS judged, best FROM documents LEFT JOIN j USING (doc_id)""")
def judged_attached(spark, sf_dir):
    """What a judge said of each row, where it said anything."""
    j = table(spark, sf_dir, "labels").groupBy("doc_id").agg(n_rows().alias("judged"), F.max("quality").alias("best"))
    return table(spark, sf_dir, "documents").select("doc_id").join(j, "doc_id", "left").select("doc_id", F.coalesce("judged", F.lit(0)).alias("judged"), "best")


@query("""WITH o AS (SELECT s_suppkey AS option, s_nationkey AS size, CAST(round(abs(s_acctbal)) AS BIGINT) % 900 + 100 AS cents, s_suppkey % 3 <> 0 AS from_price FROM supplier), d AS (SELECT option, cents + 250 AS door FROM o WHERE option % 5 = 0), a AS (SELECT DISTINCT cents AS stated FROM o WHERE from_price),
p AS (SELECT a.stated, o.option, o.size FROM a JOIN o ON o.cents = a.stated AND o.from_price), own AS (SELECT stated, max(door) AS door FROM p JOIN d USING (option) GROUP BY stated), f AS (SELECT stated, min(o.cents) AS fixed FROM (SELECT DISTINCT stated, size FROM p) JOIN o USING (size) WHERE NOT o.from_price GROUP BY stated)
SELECT a.stated, coalesce(door, fixed) AS door_cents FROM a LEFT JOIN own USING (stated) LEFT JOIN f USING (stated)""")
def door_delivery(spark, sf_dir):
    """A parcel's price to the door: its own highest door price, else the cheapest fixed price of its size."""
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("option"), F.col("s_nationkey").alias("size"), (F.round(F.abs("s_acctbal")).cast("long") % 900 + 100).alias("cents"), (F.col("s_suppkey") % 3 != 0).alias("from_price"))
    door = o.where("option % 5 = 0").select("option", (F.col("cents") + 250).alias("door"))
    packages = o.where("from_price").select(F.col("cents").alias("stated"), "option", "size")
    own = packages.join(door, "option").groupBy("stated").agg(F.max("door").alias("door"))
    least = o.where("not from_price").groupBy("size").agg(F.min("cents").alias("fixed"))
    fixed = packages.join(least, "size").groupBy("stated").agg(F.min("fixed").alias("fixed"))
    return packages.select("stated").distinct().join(own, "stated", "left").join(fixed, "stated", "left").select("stated", F.coalesce("door", "fixed").alias("door_cents"))


# what texts say

# one row for each word that follows another, and phrases as joined words
_SOLD_SQL = """w AS (SELECT doc_id, row_number() OVER () AS nth, t, list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
follows AS (SELECT nth, words[i] AS a, words[i + 1] AS b FROM (SELECT nth, words, unnest(range(1, length(words))) AS i FROM w)),
happened(a, b) AS (SELECT x, y FROM (VALUES ('bereits'), ('schon'), ('ist'), ('wurde'), ('leider')) l(x), (VALUES ('verkauft'), ('reserviert'), ('vergeben'), ('weg')) r(y)
  UNION ALL VALUES ('already', 'sold'), ('been', 'sold'), ('is', 'sold'), ('déjà', 'vendu'), ('al', 'verkocht')),
said AS (SELECT DISTINCT nth FROM follows JOIN happened USING (a, b)),
no_more AS (SELECT nth FROM w, (VALUES ('nicht mehr verfügbar'), ('nicht mehr verfugbar'), ('nicht mehr zu haben'), ('nicht mehr da'), ('no longer available'), ('nie meer beschikbaar')) p(phrase) WHERE contains(concat(' ', array_to_string(words, ' '), ' '), concat(' ', phrase, ' ')))"""


@query(f"""WITH {_SOLD_SQL} SELECT doc_id, nth IN (SELECT nth FROM said) OR nth IN (SELECT nth FROM no_more) AS sold,
regexp_matches(t, 'für bastler|als defekt|defekt verkauft|for (parts|spares)|not working|non funzionante|hors service|werkt niet') AS defective, regexp_matches(t, 'nur (an )?(selbst)?abhol|nur zur abholung|keine?n? versand') AS pickup_only FROM w""")
def sale_marks(spark, sf_dir):
    """What whole texts say of the sale: gone, broken, or only for collection."""
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", sale.text_says_sold(t).alias("sold"), sale.says_defective(t).alias("defective"), sale.pickup_only(t).alias("pickup_only"))


@query(f"""{_WITH} SELECT id, coalesce(sale_type, CASE WHEN platform IN ('EUROPE', 'ASIA') THEN 'FIXED_PRICE' END) AS sale_type FROM listings""")
def stated_sale(spark, sf_dir):
    """An unstated way of sale is a fixed price where the market has no auctions."""
    none = F.when(F.col("platform").isin("EUROPE", "ASIA"), "FIXED_PRICE")
    return listings(spark, sf_dir).select("id", F.coalesce("sale_type", none).alias("sale_type"))


@query("WITH k AS (SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(lower(coalesce(text, '')), '([0-9]{1,2}) ?x ?([0-9]{1,4} ?(?:gb|tb))', 0), lambda m: CASE WHEN CAST(regexp_extract(m, '^[0-9]+') AS BIGINT) >= 2 THEN CAST(regexp_extract(m, '^[0-9]+') AS BIGINT) * CAST(regexp_extract(m, 'x ?([0-9]+)', 1) AS BIGINT) * CASE WHEN ends_with(m, 'tb') THEN 1000 ELSE 1 END ELSE 0 END), 'max') AS gb FROM (SELECT doc_id, text FROM documents UNION ALL SELECT p_partkey, concat(p_size % 6, 'x', p_size * 8, ' GB ', p_name) FROM part)) SELECT doc_id, CAST(coalesce(gb, 0) AS BIGINT) AS gb FROM k")
def pack_size(spark, sf_dir):
    """The greatest size that a count and a size in a text make together; a single one is no pack."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.col("p_size") % 6, F.lit("x"), F.col("p_size") * 8, F.lit(" GB "), "p_name").alias("text"))
    return d.unionByName(p).select("doc_id", text.pack_gb(F.coalesce("text", F.lit(""))).alias("gb"))


@query(f"""{_WITH}, m AS (SELECT unnest(['ring', 'red ring', 'bolt', 'steel bolt', 'large']) AS model), h AS (SELECT DISTINCT part, title, model FROM (SELECT DISTINCT part, title FROM listings), m WHERE contains(concat(' ', lower(title), ' '), concat(' ', model, ' ')))
SELECT part, max_by(model, struct_pack(n := len(model), m := model)) AS model FROM h GROUP BY part""")
def longest_model(spark, sf_dir):
    """The longest model name in a title."""
    titles = listings(spark, sf_dir).select("part", "title").distinct()
    return titles.select("part", text.longest_name(F.col("title"), ["ring", "red ring", "bolt", "steel bolt", "large"]).alias("model")).where("model is not null")


@query("WITH w AS (SELECT DISTINCT regexp_extract(lower(text), '^[a-z]+') AS word FROM conversations) SELECT word, levenshtein(word, 'the') AS edits FROM w WHERE word <> '' AND levenshtein(word, 'the') <= 2")
def spelled_alike(spark, sf_dir):
    """Words within two edits of one asked for."""
    w = table(spark, sf_dir, "conversations").select(F.regexp_extract(F.lower("text"), "^[a-z]+", 0).alias("word")).where("word <> ''").distinct()
    return w.select("word", F.levenshtein("word", F.lit("the"), 2).cast("long").alias("edits")).where("edits between 0 and 2")


_ISO = {"ALGERIA": "DZ", "ARGENTINA": "AR", "BRAZIL": "BR", "CANADA": "CA", "CHINA": "CN", "EGYPT": "EG", "ETHIOPIA": "ET", "FRANCE": "FR", "GERMANY": "DE", "INDIA": "IN", "INDONESIA": "ID", "IRAN": "IR", "IRAQ": "IQ", "JAPAN": "JP", "JORDAN": "JO", "KENYA": "KE", "MOROCCO": "MA", "MOZAMBIQUE": "MZ", "PERU": "PE", "ROMANIA": "RO", "RUSSIA": "RU", "SAUDI ARABIA": "SA", "UNITED KINGDOM": "GB", "UNITED STATES": "US", "VIETNAM": "VN"}


@query("SELECT n_nationkey, CASE n_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ISO.items()) + " END AS iso FROM nation")
def country_codes(spark, sf_dir):
    """A country's two letters by its name; unknown names have none."""
    codes = spark.createDataFrame(list(_ISO.items()), "n_name string, iso string")
    return table(spark, sf_dir, "nation").join(F.broadcast(codes), "n_name", "left").select("n_nationkey", "iso")


# small calculations


@query(f"""{_WITH} SELECT id, round((p % 101 / 100.0 * (s % 101 / 100.0 * 8.0 + (1 - s % 101 / 100.0) * 37.3) + (1 - p % 101 / 100.0) * 56.0) * 1000) / 1000 AS cent_per_kwh FROM (SELECT id, part AS p, power_kw AS s FROM listings)""")
def charging_price(spark, sf_dir):
    """A kWh's price at a mix of home solar, home grid and public charging."""
    cent = fit.charging_cent(F.col("part") % 101, F.col("power_kw") % 101)
    return listings(spark, sf_dir).select("id", (F.round(cent * 1000) / 1000).alias("cent_per_kwh"))


@query(f"""{_WITH} SELECT id, CASE WHEN part % 5 = 0 OR (part % 5 = 1 AND sale_type = 'AUCTION') THEN 0.0::DOUBLE WHEN part % 5 = 2 THEN NULL WHEN currency <> 'EUR' THEN NULL ELSE CASE WHEN part % 2 = 0 THEN shipping_cents + 250 ELSE shipping_cents END / 100.0 END AS shipping_eur FROM listings""")
def buyers_shipping(spark, sf_dir):
    """What delivery to the door costs: nothing where free or only for collection, unknown without a price in EUR."""
    free, pickup = F.col("part") % 5 == 0, (F.col("part") % 5 == 1) & (F.col("sale_type") == "AUCTION")
    door = F.when(F.col("part") % 2 == 0, F.col("shipping_cents") + 250)
    cost = F.when(F.col("part") % 5 != 2, F.coalesce(door, F.col("shipping_cents")))
    return listings(spark, sf_dir).select("id", sale.shipping_eur(free, F.coalesce(pickup, F.lit(False)), cost, F.col("currency")).alias("shipping_eur"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e), s AS (SELECT *, list_sum(list_transform(v, lambda x: exp(x - top))) AS total FROM m)
SELECT vec_id, round(1.0 / total * 1000000) / 1000000 AS top_share, round(-ln(total) * 1000000) / 1000000 AS top_log_share, round(top / norm * 1000000) / 1000000 AS top_unit FROM s""")
def softmax_of_vectors(spark, sf_dir):
    """Of each vector's greatest value: its softmax, log-softmax, and what it is in the vector of length one."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", six(F.array_max(numbers.softmax(F.col("v")))).alias("top_share"), six(F.array_max(numbers.log_softmax(F.col("v")))).alias("top_log_share"), six(F.array_max(numbers.unit(F.col("v")))).alias("top_unit"))


@query(f"{_WITH} SELECT id, CAST(sold_at AS DATE) > DATE '1997-01-01' AS on_order, strftime(sold_at, '%m/%Y') AS month, CASE WHEN h < 1 THEN concat('~', CAST(round(h * 4) * 15 AS BIGINT), ' min') ELSE concat('~', CAST(round(h) AS BIGINT), ' h') END AS drive FROM (SELECT *, place * 0.15 + 0.11 AS h FROM listings)")
def labels_of_rows(spark, sf_dir):
    """Whether a thing is still to come, its month, and a drive's time in words."""
    hours = F.col("place") * 0.15 + 0.11
    return listings(spark, sf_dir).select("id", (F.col("sold_at").cast("date") > F.lit("1997-01-01").cast("date")).alias("on_order"), F.date_format("sold_at", "MM/yyyy").alias("month"), fit.hours_label(hours).alias("drive"))


@query(f"{_WITH} SELECT id, concat(replace(format('{{:,}}', price_cents // 100), ',', '.'), ',', lpad(CAST(price_cents % 100 AS VARCHAR), 2, '0'), ' ', CASE currency WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' ELSE currency END) AS shown FROM listings")
def prices_as_shown(spark, sf_dir):
    """Cents as a price that is read: dots between thousands, a comma before the cents."""
    return listings(spark, sf_dir).select("id", text.shown_price(F.col("price_cents"), F.col("currency")).alias("shown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"event\":', event_id, ',\"k\":', CAST(json_extract(props, '$.k') AS BIGINT), '}') AS doc FROM events")
def nested_json(spark, sf_dir):
    """A nested record read from JSON, and written again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return rows.select("event_id", "p.k", F.to_json(F.struct(F.col("event_id").alias("event"), F.col("p.k").alias("k"))).alias("doc"))


@query(f"{_WITH} SELECT id, replace(replace('Is the {{title}} still there for {{price}}? {{name}}', '{{title}}', title), '{{price}}', CAST(price_cents // 100 AS VARCHAR)) AS message, true AS open FROM listings WHERE NOT sold".replace("{{", "{").replace("}}", "}"))
def filled_templates(spark, sf_dir):
    """A message with its places filled in, and whether one is still open."""
    values = {"title": F.col("title"), "price": F.expr("price_cents div 100").cast("string")}
    message = text.fill(F.lit("Is the {title} still there for {price}? {name}"), values)
    return listings(spark, sf_dir).where("not sold").select("id", message.alias("message"), text.has_open_place(message).alias("open"))


# weighed fit

_FIT_SQL = f"""e AS (SELECT *, ({_EUR_SQL}) / 100.0 AS eur FROM listings WHERE NOT sold), r AS (SELECT *, place * 8.0 AS km FROM e WHERE NOT (condition IS NOT DISTINCT FROM 'PARTS_ONLY') AND NOT contains(lower(title), 'blue')),
s AS (SELECT id, CASE WHEN power_kw BETWEEN 20 AND 30 THEN 1.0 WHEN power_kw BETWEEN 15 AND 35 THEN 0.6 ELSE 0.1 END AS size, greatest(0, least(1, (eur - 20600.0) / (5000.0 - 20600.0))) AS price, CASE WHEN mileage_km IS NOT NULL THEN greatest(0, least(1, (mileage_km - 133000.0) / (40000.0 - 133000.0))) END AS mileage,
CASE WHEN first_year IS NOT NULL THEN greatest(0, least(1, (first_year - 1992.0) / (1996.0 - 1992.0))) END AS year, greatest(0, least(1, (power_kw - -5.0) / (30.0 - -5.0))) AS power, CASE sale_type WHEN 'FIXED_PRICE' THEN 1.0 WHEN 'AUCTION' THEN 0.1 ELSE 0.5 END AS gear, greatest(0, least(1, (km * 0.0125 - 4.0) / (0.0 - 4.0))) AS distance FROM r)"""
_WEIGHTS = {"size": 0.26, "price": 0.22, "mileage": 0.11, "year": 0.09, "power": 0.20, "gear": 0.12, "distance": 0.03}
_TOTAL = " + ".join(map(str, _WEIGHTS.values()))


def _wished(spark, sf_dir):
    rows = listings(spark, sf_dir).where("not sold").withColumn("eur", _eur() / 100.0)
    rows = rows.where(~F.col("condition").eqNullSafe("PARTS_ONLY") & ~F.contains(F.lower("title"), F.lit("blue")))
    c = F.col
    wishes = [
        ("size", fit.size_wish(c("power_kw"), (20, 30), (15, 35))),
        ("price", numbers.ramp(c("eur"), 20600.0, 5000.0)),
        ("mileage", numbers.ramp(c("mileage_km"), 133000.0, 40000.0)),
        ("year", numbers.ramp(c("first_year"), 1992.0, 1996.0)),
        ("power", numbers.ramp(c("power_kw"), -5.0, 30.0)),
        ("gear", fit.stated_wish(c("sale_type"), "FIXED_PRICE", 0.5, 0.1)),
        ("distance", numbers.ramp(numbers.drive_hours(c("place") * 8.0), 4.0, 0.0)),
    ]
    return rows.select("id", fit.weighed([(n, w, _WEIGHTS[n]) for n, w in wishes]).alias("parts"))


@query(f"{_WITH}, {_FIT_SQL} SELECT id, round((" + " + ".join(f"coalesce({n}, 0.45) * {w}" for n, w in _WEIGHTS.items()) + f") / ({_TOTAL}) * 100000) / 100000 AS score FROM s")
def vehicle_fit(spark, sf_dir):
    """How well an offer fits its wishes: each weighs its share, one that the ad doesn't answer a little under half; broken
    and excluded offers have no score and are left out."""
    return _wished(spark, sf_dir).select("id", (F.round(fit.score(F.col("parts")) * 1e5) / 1e5).alias("score"))


@query(
    f"{_WITH}, {_FIT_SQL}, p AS (SELECT id, unnest({list(_WEIGHTS)!r}) AS wish, unnest([" + ", ".join(f"coalesce({n}, 0.45)" for n in _WEIGHTS) + "])::DOUBLE AS got, unnest([" + ", ".join(f"{w}" for w in _WEIGHTS.values()) + f"])::DOUBLE / ({_TOTAL}) * 100 AS of FROM s), "
    "l AS (SELECT id, wish, CAST(round((1 - got) * of) AS BIGINT) AS lost FROM p), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lost DESC, wish) AS rn FROM l WHERE lost >= 1) SELECT id, wish, lost FROM ranked WHERE rn <= 4"
)
def biggest_losses(spark, sf_dir):
    """The wishes that cost an offer the most: four at most, a point at least."""
    parts = _wished(spark, sf_dir)
    lost = F.transform("parts", lambda p: F.struct((-F.round((1 - p["got"]) * p["of"]).cast("long")).alias("lost"), p["wish"].alias("wish")))
    top = F.slice(F.array_sort(F.filter(lost, lambda x: x["lost"] <= -1)), 1, 4)
    return parts.select("id", F.explode(top).alias("x")).select("id", "x.wish", (-F.col("x.lost")).alias("lost"))


@query(f"{_WITH}, {_FIT_SQL}, f AS (SELECT id, (" + " + ".join(f"coalesce({n}, 0.45) * {w}" for n, w in _WEIGHTS.items()) + f") / ({_TOTAL}) AS fit FROM s), t AS (SELECT id, CASE WHEN part % 3 = 0 THEN NULL ELSE (part % 100) / 100.0 END AS told FROM listings) SELECT id, round((CASE WHEN told IS NULL THEN fit ELSE (fit + told) / 2 END) * 100000) / 100000 AS blended FROM f JOIN t USING (id)")
def blended_fit(spark, sf_dir):
    """The mean of an offer's fit and of what its description is like; the fit alone where there is no description."""
    told = listings(spark, sf_dir).where("not sold").select("id", F.when(F.col("part") % 3 != 0, (F.col("part") % 100) / 100.0).alias("told"))
    both = _wished(spark, sf_dir).select("id", fit.score(F.col("parts")).alias("fit")).join(told, "id")
    return both.select("id", (F.round(F.coalesce((F.col("fit") + F.col("told")) / 2, F.col("fit")) * 1e5) / 1e5).alias("blended"))

"""Queries over what sellers write, pages of answers, and what searches remember between runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlane.functions import text
from offerlane.operators import repairs
from offerlane.plans.registry import query
from offerlane.sources.tables import LISTINGS_SQL, OBSERVATIONS_SQL, listings, observations, table

_WITH, _OBS = f"WITH {LISTINGS_SQL}", f"WITH {OBSERVATIONS_SQL}"

#: What the sellers of nine parts in ten write, as SQL that Spark and DuckDB read alike.
_SAYS = """CASE part % 10
 WHEN 0 THEN concat('Preis: ', CAST(floor(price_cents / 20) AS BIGINT), ' EUR')
 WHEN 1 THEN concat('VB 900 euro, Preis ', CAST(floor(price_cents / 20) AS BIGINT), ' euro. Laufleistung: 79.900 km')
 WHEN 2 THEN 'Preis 2019 gekauft, 6-Gang-Schaltgetriebe, Kilometerstand 4.000.000 km'
 WHEN 3 THEN '56.999€ VB, 52.000 € bei Abholung. Automatikgetriebe. Zu vermieten pro Woche oder am Wochenende'
 WHEN 4 THEN 'Überführung 990 €, Zulassung: 150 EUR und Zulassung 170 EUR'
 WHEN 5 THEN 'inkl. Überführung 990 €. Bereitstellung 9.000 €, Bereitstellung 300 €'
 WHEN 6 THEN concat('Netto zzgl. MwSt., brutto ', CAST(floor(price_cents / 100 * 1.18) AS BIGINT), ' €')
 WHEN 7 THEN 'Netto zzgl. MwSt. Schaltgetriebe statt Automatikgetriebe'
 WHEN 8 THEN 'Rüttelplatte aus der Vermietung, Mietpreis 40 € pro Tag' END"""


def _said(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("says", F.expr(_SAYS))


_SAID = f"{_WITH}, said AS (SELECT *, {_SAYS} AS says FROM listings)"


def _numbers(pattern: str, said: str = "lower(says)") -> str:
    return f"list_transform(regexp_extract_all({said}, '{pattern}', 1), lambda s: TRY_CAST(replace(s, '.', '') AS BIGINT))"


@query(f"""{_SAID}, a AS (SELECT *, list_distinct(list_filter({_numbers(repairs.ASK)}, lambda x: x > 0)) AS asks FROM said)
SELECT id, CASE WHEN currency = 'EUR' AND len(asks) = 1 AND asks[1] * 100 >= price_cents * {repairs.TOKEN_FACTOR} THEN asks[1] * 100 ELSE price_cents END AS price_cents FROM a""")
def asked_in_text(spark, sf_dir):
    c = F.col
    return _said(spark, sf_dir).select("id", repairs.asked_in_text(c("price_cents"), c("currency"), c("says")).alias("price_cents"))


@query(f"""{_SAID}, f AS (SELECT id, currency, says, CASE WHEN buyer % 3 = 0 THEN 1234500 ELSE price_cents END AS cents FROM said)
SELECT id, CASE WHEN currency = 'EUR' AND cents % 100 = 0 AND length(CAST(cents // 100 AS VARCHAR)) >= 4 AND starts_with('123456789', CAST(cents // 100 AS VARCHAR))
 THEN coalesce(list_filter({_numbers(repairs.EUROS)}, lambda x: x * 100 > cents)[1] * 100, cents) ELSE cents END AS price_cents FROM f""")
def stated_price(spark, sf_dir):
    """The text's price, where the form's is digits that only fill the field."""
    c = F.col
    rows = _said(spark, sf_dir).withColumn("cents", F.when(c("buyer") % 3 == 0, F.lit(1_234_500).cast("long")).otherwise(c("price_cents")))
    return rows.select("id", repairs.stated_price(c("cents"), c("currency"), c("says")).alias("price_cents"))


_FORM_SQL = "CASE WHEN part % 3 = 0 THEN 'MANUAL' WHEN part % 3 = 1 THEN 'AUTOMATIC' END"


@query(f"""{_SAID}, m AS (SELECT id, mileage_km, {_FORM_SQL} AS form, {_numbers(repairs.MILEAGE)}[1] AS km, regexp_matches(lower(says), '{repairs.MANUAL}') AS manual, regexp_matches(lower(says), '{repairs.AUTOMATIC}') AS automatic FROM said),
s AS (SELECT id, mileage_km, form, CASE WHEN km BETWEEN 1 AND 2000000 THEN km END AS km, CASE WHEN form IS NULL THEN NULL WHEN manual AND NOT automatic THEN 'MANUAL' WHEN automatic AND NOT manual THEN 'AUTOMATIC' END AS box FROM m)
SELECT id, coalesce(km, mileage_km) AS mileage_km, coalesce(box, form) AS gearbox,
 concat_ws(',', CASE WHEN box IS NULL OR box = form THEN 'gearbox' END, CASE WHEN km IS NULL OR km IS NOT DISTINCT FROM mileage_km THEN 'mileage' END) AS verified FROM s""")
def stated_mileage_and_gearbox(spark, sf_dir):
    """Mileage and gearbox as the text states them; a field it contradicts is no longer verified."""
    form = F.when(F.col("part") % 3 == 0, "MANUAL").when(F.col("part") % 3 == 1, "AUTOMATIC")
    rows = _said(spark, sf_dir).withColumn("form", form).withColumn("verified", F.array(F.lit("gearbox"), F.lit("mileage")))
    km, verified = repairs.overridden(F.col("mileage_km"), repairs.stated_mileage(F.col("says")), F.col("verified"), "mileage")
    box = F.when(F.col("form").isNotNull(), repairs.stated_gearbox(F.col("says")))
    gearbox, verified = repairs.overridden(F.col("form"), box, verified, "gearbox")
    return rows.select("id", km.alias("mileage_km"), gearbox.alias("gearbox"), F.array_join(verified, ",").alias("verified"))


_FEES_SQL = " + ".join(f"coalesce(list_filter({_numbers(repairs.FEE.format(kind=k), 'bare')}, lambda x: x BETWEEN 50 AND 3000)[1], 0)" for k in repairs.FEES)


@query(f"""{_SAID}, b AS (SELECT id, regexp_replace(lower(says), '{repairs.INCLUDED}', ' ', 'g') AS bare FROM said), f AS (SELECT id, {_FEES_SQL} AS euros FROM b) SELECT id, euros * 100 AS fees_cents FROM f WHERE euros > 0""")
def dealer_fees(spark, sf_dir):
    """Each kind of fee named on top of the price, once, summed."""
    return _said(spark, sf_dir).select("id", repairs.dealer_fees(F.col("says")).alias("fees_cents")).where("fees_cents is not null")


@query(f"""{_SAID}, g AS (SELECT id, price_cents, currency, 19 + place % 3 AS vat, says, {_numbers(repairs.GROSS)} AS gross FROM said),
n AS (SELECT *, list_filter(gross, lambda g: g > price_cents // 100 AND g * 10000 <= (price_cents // 100) * (100 + vat) * 101)[1] AS near FROM g)
SELECT id, CASE WHEN NOT coalesce(currency = 'EUR' AND regexp_matches(lower(says), '{repairs.NET}'), false) THEN price_cents WHEN near IS NOT NULL THEN near * 100
 WHEN len(gross) > 0 OR contains(lower(says), '{repairs.WITH_VAT}') THEN price_cents ELSE (price_cents * (100 + vat) + 50) // 100 END AS price_cents FROM n""")
def gross_price(spark, sf_dir):
    c = F.col
    return _said(spark, sf_dir).select("id", repairs.gross_price(c("price_cents"), c("currency"), 19 + c("place") % 3, c("says")).alias("price_cents"))


_AT_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(says), '{p}') THEN {{'p': length(regexp_extract(lower(says), '^(.*?)(?:{p})', 1)), 'n': '{n}'}} END" for n, p in repairs.PERIODS.items())


@query(f"""{_SAID} SELECT id, CASE WHEN regexp_matches(lower(says), '{repairs.HIRED}') AND NOT regexp_matches(lower(says), '{repairs.FROM_FLEET}') THEN 'RENT' ELSE sale_type END AS sale_type,
 list_min(list_filter([{_AT_SQL}], lambda x: x IS NOT NULL)).n AS period FROM said WHERE says IS NOT NULL""")
def rent_marking(spark, sf_dir):
    """Offers whose text says that they are hired out, and the period it names first."""
    rows = _said(spark, sf_dir).where("says is not null")
    return rows.select("id", F.when(repairs.hired_out(F.col("says")), "RENT").otherwise(F.col("sale_type")).alias("sale_type"), repairs.rent_period(F.col("says")).alias("period"))


@query(f"""{_WITH}, f AS (SELECT id, first_year AS y, mileage_km AS k, CASE WHEN part % 4 <> 0 THEN power_kw END AS p, CASE WHEN buyer % 3 <> 0 THEN CAST(1990 + part % 10 AS INTEGER) END AS ty, CASE WHEN buyer % 3 <> 0 THEN part * 100 END AS tk FROM listings)
SELECT id, coalesce(y, ty) AS year, coalesce(k, tk) AS mileage, p AS power, concat_ws(',', CASE WHEN y IS NOT NULL THEN 'year' END, CASE WHEN k IS NOT NULL THEN 'mileage' END, CASE WHEN p IS NOT NULL THEN 'power' END) AS verified, y AS sure_year, k AS sure_mileage FROM f""")
def form_over_text(spark, sf_dir):
    """A form's fields over the text's, which fields are verified, and only those."""
    by_text = F.col("buyer") % 3 != 0
    form = {"year": F.col("first_year"), "mileage": F.col("mileage_km"), "power": F.when(F.col("part") % 4 != 0, F.col("power_kw"))}
    said = {"year": F.when(by_text, (1990 + F.col("part") % 10).cast("int")), "mileage": F.when(by_text, F.col("part") * 100), "power": F.lit(None).cast("int")}
    both, verified = repairs.merged(form, said), repairs.verified_by_presence(form)
    rows = listings(spark, sf_dir).select("id", *(c.alias(n) for n, c in both.items()), verified.alias("v"))
    sure = repairs.verified_only({n: F.col(n) for n in both}, F.col("v"))
    return rows.select("id", *both, F.array_join("v", ",").alias("verified"), sure["year"].alias("sure_year"), sure["mileage"].alias("sure_mileage"))


@query(f"""{_WITH}, a AS (SELECT platform, part // 10 AS page, buyer AS item, min(price_cents) AS cents FROM listings GROUP BY ALL), f AS (SELECT platform, item, min(page) AS page, arg_min(cents, page) AS cents FROM a GROUP BY ALL),
n AS (SELECT g.platform, g.page, count(f.item) AS fresh FROM (SELECT DISTINCT platform, page FROM a) g LEFT JOIN f USING (platform, page) GROUP BY ALL),
s AS (SELECT *, min(CASE WHEN fresh = 0 THEN page END) OVER w AS empty, coalesce(sum(fresh) OVER (PARTITION BY platform ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WINDOW w AS (PARTITION BY platform))
SELECT f.platform, f.page, f.item, f.cents FROM f JOIN s USING (platform, page) WHERE (empty IS NULL OR f.page < empty) AND before < 120""")
def paged_answer(spark, sf_dir):
    """A source's pages, each item from its first page, until a page brings nothing new or 120 items are in."""
    rows = listings(spark, sf_dir).select("platform", F.expr("part div 10").alias("page"), F.col("buyer").alias("item"), "price_cents")
    a = rows.groupBy("platform", "page", "item").agg(F.min("price_cents").alias("cents"))
    first = a.groupBy("platform", "item").agg(F.min("page").alias("page"), F.min_by("cents", "page").alias("cents"))
    fresh = a.select("platform", "page").distinct().join(first.groupBy("platform", "page").agg(F.count(F.lit(1)).alias("n")), ["platform", "page"], "left")
    # the windows run over pages, not items
    w = Window.partitionBy("platform")
    before = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = fresh.select("platform", "page", F.min(F.when(F.col("n").isNull(), F.col("page"))).over(w).alias("empty"), before.alias("before"))
    read = read.where("(empty is null or page < empty) and before < 120").select("platform", "page")
    return first.join(read, ["platform", "page"]).select("platform", "page", "item", "cents")


@query(f"""{_WITH}, p AS (SELECT platform, id, price_cents, row_number() OVER (PARTITION BY platform ORDER BY price_cents, id) AS rn FROM listings WHERE NOT sold), f AS (SELECT platform, max(price_cents) AS floor_cents FROM p WHERE rn <= 100 GROUP BY platform)
SELECT platform, id, price_cents, CAST(CASE WHEN rn <= 100 THEN 1 ELSE 2 END AS INTEGER) AS pass FROM p JOIN f USING (platform) WHERE rn <= 100 OR price_cents >= floor_cents""")
def keyset_rescan(spark, sf_dir):
    """Where a source's pages end while full, a new answer begins at the dearest price read; an offer read twice counts once."""
    rows = listings(spark, sf_dir).where("not sold").select("platform", "id", "price_cents")
    rank = F.row_number().over(Window.partitionBy("platform").orderBy("price_cents", "id"))
    read = rows.withColumn("rn", rank).where("rn <= 100").drop("rn").withColumn("pass", F.lit(1))
    floor = read.groupBy("platform").agg(F.max("price_cents").alias("floor_cents"))  # a row for each source
    again = rows.join(F.broadcast(floor), "platform").where("price_cents >= floor_cents").drop("floor_cents").withColumn("pass", F.lit(2))
    return again.join(read.select("id"), "id", "left_anti").select(*read.columns).unionByName(read)


_SIZED = "concat(title, CASE part % 5 WHEN 0 THEN ' 2TB' WHEN 1 THEN ' 1TB / 2TB' WHEN 2 THEN ' 2TB (2x 1TB)' WHEN 3 THEN ' 512GB' ELSE '' END)"
_LIST_SQL = "list_sort(list_distinct(list_transform(regexp_extract_all(lower(t), '([0-9]+ ?(?:gb|tb))(?:$|[^a-z0-9])', 1), lambda p: CAST(regexp_extract(p, '^[0-9]+') AS BIGINT) * CASE WHEN suffix(p, 'tb') THEN 1000 ELSE 1 END)))"


@query(f"""{_WITH}, t AS (SELECT id, {_SIZED} AS t FROM listings), s AS (SELECT id, t, {_LIST_SQL} AS sizes FROM t)
SELECT id, CASE WHEN regexp_matches(lower(t), '2x ?1tb') THEN NULL WHEN len(sizes) >= 2 AND len(list_filter(sizes, lambda x: x < 2000 AND x >= 40)) > 0 THEN 'one of several sizes'
 WHEN len(sizes) > 0 AND NOT list_contains(sizes, 2000) THEN 'another size' END AS drop_reason FROM s""")
def size_vetoes(spark, sf_dir):
    """For a search for 2 TB: titles that offer smaller sizes beside it, and titles of another size. Pieces that add up to it are it."""
    rows = listings(spark, sf_dir).select("id", F.expr(_SIZED).alias("t"))
    rows = rows.withColumn("sizes", text.sizes_gb(F.col("t")))
    several = (F.size("sizes") >= 2) & F.exists("sizes", lambda x: (x < 2000) & (x >= 40))
    other = (F.size("sizes") > 0) & ~F.array_contains("sizes", F.lit(2000).cast("long"))
    pieces = F.rlike(F.lower("t"), F.lit("2x ?1tb"))
    return rows.select("id", F.when(pieces, F.lit(None).cast("string")).when(several, "one of several sizes").when(other, "another size").alias("drop_reason"))


_TOP_SQL = """d AS (SELECT search, CAST(seen AS DATE) AS run, offer, max(price_cents) AS score FROM observations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY search, run ORDER BY score DESC, offer) AS rn FROM d),
t AS (SELECT search, run, offer FROM r WHERE rn <= 10), c AS (SELECT search, run, lead(run) OVER (PARTITION BY search ORDER BY run) AS next FROM (SELECT DISTINCT search, run FROM d))"""


@query(f"""{_OBS}, {_TOP_SQL}, n AS (SELECT t.search, c.next AS run, t.offer, 1 AS was, 0 AS "is" FROM t JOIN c USING (search, run) WHERE c.next IS NOT NULL UNION ALL SELECT search, run, offer, 0, 1 FROM t),
g AS (SELECT search, run, offer, max(was) AS was, max("is") AS "is" FROM n GROUP BY ALL) SELECT search, run, offer, CASE WHEN "is" = 1 THEN 'FOUND' ELSE 'LOST' END AS event FROM g WHERE was <> "is" """)
def top_ten_changes(spark, sf_dir):
    """Which offers came into a search's ten best with a run, and which left them."""
    d = observations(spark, sf_dir).groupBy("search", F.col("seen").cast("date").alias("run"), "offer").agg(F.max("price_cents").alias("score"))
    rank = F.row_number().over(Window.partitionBy("search", "run").orderBy(F.desc("score"), "offer"))
    top = d.withColumn("rn", rank).where("rn <= 10").select("search", "run", "offer")
    runs = d.select("search", "run").distinct().withColumn("next", F.lead("run").over(Window.partitionBy("search").orderBy("run")))
    was = top.join(runs, ["search", "run"]).where("next is not null").select("search", F.col("next").alias("run"), "offer", F.lit(1).alias("was"), F.lit(0).alias("now"))
    both = was.unionByName(top.select("search", "run", "offer", F.lit(0).alias("was"), F.lit(1).alias("now")))
    g = both.groupBy("search", "run", "offer").agg(F.max("was").alias("was"), F.max("now").alias("now")).where("was <> now")
    return g.select("search", "run", "offer", F.when(F.col("now") == 1, "FOUND").otherwise("LOST").alias("event"))


@query(f"{_OBS} SELECT search, offer, min(seen) AS told_at FROM observations WHERE price_cents >= 5000 GROUP BY ALL")
def floor_crossings(spark, sf_dir):
    """An offer is told of once: when it first reaches the floor."""
    return observations(spark, sf_dir).where("price_cents >= 5000").groupBy("search", "offer").agg(F.min("seen").alias("told_at"))


@query(f"""{_OBS}, d AS (SELECT search, offer, min(CAST(seen AS DATE)) AS first FROM observations GROUP BY ALL), c AS (SELECT search, run, lead(run) OVER (PARTITION BY search ORDER BY run) AS next FROM (SELECT DISTINCT search, CAST(seen AS DATE) AS run FROM observations))
SELECT d.search, d.offer, d.first, CASE WHEN d.offer % 3 = 0 THEN c.next ELSE d.first END AS told FROM d JOIN c ON d.search = c.search AND d.first = c.run""")
def held_back_a_run(spark, sf_dir):
    """A new offer is told of in the run that saw it first, or in the next one where its page is unread."""
    seen = observations(spark, sf_dir).select("search", "offer", F.col("seen").cast("date").alias("first"))
    runs = seen.select("search", "first").distinct().withColumn("next", F.lead("first").over(Window.partitionBy("search").orderBy("first")))
    new = seen.groupBy("search", "offer").agg(F.min("first").alias("first"))
    return new.join(runs, ["search", "first"]).select("search", "offer", "first", F.when(F.col("offer") % 3 == 0, F.col("next")).otherwise(F.col("first")).alias("told"))


@query("""WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id > 100 AND ts >= TIMESTAMP '2024-01-10 00:00:00') SELECT user_id, event_id, ts FROM r WHERE rn <= 200""")
def outbox_pending(spark, sf_dir):
    """What a device hasn't acknowledged and hasn't expired: its newest 200 messages, for delivery at least once."""
    e = table(spark, sf_dir, "events").where((F.col("event_id") > 100) & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-10 00:00:00'"))).select("user_id", "event_id", "ts")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("rn", rank).where("rn <= 200").drop("rn")

"""Lookups, pattern joins, series joins, neighbours and similarity."""

from pyspark.sql import functions as F

from catloom.checks.base import check, define, table, view
from catloom.operators import joins, similarity

# Series whose points follow from the order years, with a gap so that ties occur.
define("cpi", "orders", """
SELECT y AS year, CAST(10 + y % 100 + y % 7 AS DOUBLE) AS cpi FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) t
""")
define("fx", "orders", """
SELECT 'JPY' AS currency, y AS year, CAST(100 + y % 10 AS DOUBLE) AS rate FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) a WHERE y NOT IN (1997, 1999)
UNION ALL
SELECT 'EUR', y, CAST(5 + y % 10 AS DOUBLE) / 10 FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) b WHERE y <= 1998
""")
# Price book: one entry per brand and first word, a longer one per brand and two words.
define("price_book", "part", """
SELECT p_brand AS manufacturer, pattern, CAST(max(price) AS DOUBLE) AS price, max(currency) AS currency, max(year) AS year, CAST(max(ord) AS INT) AS ord FROM (
  SELECT p_brand, split_part(p_name, ' ', 1) AS pattern, 100.0 + length(p_name) AS price, 'USD' AS currency, 1996 AS year, 1 AS ord FROM {part} WHERE p_name LIKE 'r%' OR p_name LIKE 's%'
  UNION ALL SELECT p_brand, p_name, 2000.0 + length(p_type), 'JPY', 1999, 2 FROM {part} WHERE p_name LIKE '%t'
  UNION ALL SELECT p_brand, split_part(p_name, ' ', 2), 300.0, 'XXX', 1990, 3 FROM {part} WHERE p_name LIKE '%g') t
GROUP BY p_brand, pattern
""")
define("countries", "part nation", """
SELECT DISTINCT p_brand AS canonical, n_name AS country FROM {part} JOIN {nation} ON n_nationkey = CAST(replace(p_brand, 'Brand#', '') AS INT)
""")
define("regions", "nation region", "SELECT n_name AS country, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")

BOOK_HITS = """
hits AS (SELECT i.item_id, b.pattern, b.price, b.currency, b.year, row_number() OVER (PARTITION BY i.item_id ORDER BY (b.pattern = lower(i.name)) DESC, length(b.pattern) DESC, b.ord) AS rn
         FROM items i JOIN price_book b ON b.manufacturer = i.brand AND contains(lower(i.name), b.pattern))
"""


@check("longest_pattern_join", "items price_book", f"""
WITH {BOOK_HITS} SELECT i.item_id, h.pattern AS book_pattern, h.price AS book_price, h.currency AS book_currency, h.year AS book_year
FROM items i LEFT JOIN hits h ON h.item_id = i.item_id AND h.rn = 1""")
def _(spark, sf):
    i = view(spark, sf, "items").select("item_id", "brand", "name")
    return joins.longest_pattern_join(i, view(spark, sf, "price_book"), "item_id", "brand", "name").drop("brand", "name")


@check("fill_country", "records keyed countries", """
SELECT seq, CASE WHEN source_rank = 0 AND part_id % 3 = 0 THEN 'Elsewhere' ELSE c.country END AS country
FROM keyed LEFT JOIN countries c ON c.canonical = keyed.canonical""")
def _(spark, sf):
    k = view(spark, sf, "keyed").withColumn("country", F.when((F.col("source_rank") == 0) & (F.col("part_id") % 3 == 0), F.lit("Elsewhere")).otherwise(F.lit("")))
    return joins.fill_country(k, "canonical", "country", view(spark, sf, "countries")).select("seq", "country")


@check("fill_launch_date", "records", """
SELECT seq, coalesce(nullif(fmt, ''), CAST(year_from AS VARCHAR)) AS launch FROM records""")
def _(spark, sf):
    return view(spark, sf, "records").select("seq", joins.fill_launch_date("fmt", "year_from").alias("launch"))


@check("region_of", "", """
SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN r_name END, 'Other') AS region FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.withColumn("land", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("n_name")))
    return joins.region_of(c, "land", view(spark, sf, "regions")).select("c_custkey", "region")


@check("localized_name", "items", """
SELECT item_id, CASE WHEN size < 10 THEN 'Seagull ' || CAST(size AS VARCHAR) WHEN size < 20 THEN brand || ' 相机' || CAST(size AS VARCHAR) WHEN size < 30 THEN '海鸥 DF' WHEN size < 32 THEN 'Tai' ELSE name END AS shown FROM items""")
def _(spark, sf):
    from catloom.vocabulary import NAME_PREFIXES
    prefixes = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(NAME_PREFIXES)], "ord int, prefix string, brand string")
    size = F.col("size")
    shown = (F.when(size < 10, F.concat(F.lit("海鸥 "), size.cast("string"))).when(size < 20, F.concat(F.lit("相机"), size.cast("string")))
             .when(size < 30, F.lit("海鸥 DF")).when(size < 32, F.lit("泰")).otherwise(F.col("name")))
    i = view(spark, sf, "items").withColumn("shown", shown)
    return joins.localized_name(i, "shown", "brand", prefixes, "item_id").select("item_id", "shown")


@check("curated_match", "items", """
WITH cur AS (SELECT DISTINCT split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) AS match, CASE WHEN name LIKE 'r%' THEN 'brand#1' END AS hint FROM items
             UNION SELECT DISTINCT name, NULL FROM items WHERE name LIKE '% 7' UNION SELECT DISTINCT split_part(name, ' ', 2), NULL FROM items),
m AS (SELECT match, hint, item_id, name, CASE WHEN name = match THEN 1 WHEN starts_with(name, match) THEN 2 ELSE 3 END AS tier FROM cur JOIN items ON contains(name, match) AND (hint IS NULL OR contains(lower(brand), hint)))
SELECT match AS display, item_id, name AS item_name, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY match ORDER BY tier, length(name), item_id) AS rn FROM m) WHERE rn = 1""")
def _(spark, sf):
    i = view(spark, sf, "items")
    first, second = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
    none = F.lit(None).cast("string").alias("brand_hint")
    entries = (
        i.select(F.concat_ws(" ", first, second).alias("match"), F.when(F.startswith("name", F.lit("r")), F.lit("brand#1")).alias("brand_hint")).distinct()
        .union(i.where(F.endswith("name", F.lit(" 7"))).select(F.col("name").alias("match"), none).distinct())
        .union(i.select(second.alias("match"), none).distinct()))
    curated = entries.select("match", F.col("match").alias("display"), F.col("match").alias("ord"), "brand_hint")
    return joins.curated_match(curated, i, "item_id", "name", ["brand"]).where("item_id is not null").select("display", "item_id", "item_name", "tier")


@check("index_match", "items", """
WITH idx AS (SELECT min(item_id) AS ord, 'film' || CAST(min(item_id) AS VARCHAR) AS entry_id, split_part(name, ' ', 1) || '-' || split_part(name, ' ', 2) AS entry_name FROM items WHERE size > 20 GROUP BY 3),
n AS (SELECT ord, entry_id, regexp_replace(lower(entry_name), '[^a-z0-9]', '', 'g') AS b FROM idx),
a AS (SELECT item_id, regexp_replace(lower(CASE WHEN size < 10 THEN split_part(name, ' ', 2) ELSE name END), '[^a-z0-9]', '', 'g') AS a FROM items),
m AS (SELECT item_id, entry_id, row_number() OVER (PARTITION BY item_id ORDER BY a <> b, ord) AS rn FROM a JOIN n ON contains(a, b) OR contains(b, a))
SELECT a.item_id, m.entry_id FROM a LEFT JOIN m ON m.item_id = a.item_id AND rn = 1""")
def _(spark, sf):
    i = view(spark, sf, "items")
    entry = F.concat_ws("-", F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2)))
    idx = i.where("size > 20").groupBy(entry.alias("entry_name")).agg(F.min("item_id").alias("ord"))
    idx = idx.withColumn("entry_id", F.concat(F.lit("film"), F.col("ord").cast("string")))
    shown = F.when(F.col("size") < 10, F.concat_ws(" ", F.lit("Brand"), F.split_part("name", F.lit(" "), F.lit(2)))).otherwise(F.col("name"))
    return joins.index_match(i.select("item_id", shown.alias("name")), idx, "item_id", "name", prefix="brand").select("item_id", "entry_id")


@check("cross_mentions", "items", """
WITH b AS (SELECT DISTINCT lower(brand) AS other FROM items),
t AS (SELECT item_id, lower(brand) AS own, CASE WHEN size < 5 THEN 'brand#' || CAST(size AS VARCHAR) || ' ' || name WHEN size < 12 THEN name || ' for brand#' || CAST(size AS VARCHAR) WHEN size < 15 THEN name || ' xbrand#3' ELSE name END AS text FROM items)
SELECT item_id, own, other, CASE WHEN starts_with(text || ' ', other || ' ') THEN 'high' ELSE 'low' END AS confidence FROM t JOIN b ON contains(text, other)
AND NOT contains(own, other) AND NOT contains(other, own) AND regexp_matches(text, '(^|[^a-z0-9_])' || other || '($|[^a-z0-9_])') AND NOT (own = 'brand#10' AND other = 'brand#11')""")
def _(spark, sf):
    i = view(spark, sf, "items")
    size = F.col("size")
    text = (F.when(size < 5, F.concat(F.lit("brand#"), size, F.lit(" "), "name")).when(size < 12, F.concat("name", F.lit(" for Brand#"), size))
            .when(size < 15, F.concat("name", F.lit(" xbrand#3"))).otherwise(F.col("name")))
    brands = i.select(F.lower("brand").alias("other")).distinct()
    allowed = spark.createDataFrame([("brand#10", "brand#11")], "brand string, other string")
    return joins.cross_mentions(i.select("item_id", "brand", text.alias("text")), brands, allowed, "item_id", "brand", "text")


@check("nearest_asof_join", "listings fx", """
WITH q AS (SELECT DISTINCT currency, ship_year FROM listings),
n AS (SELECT q.currency, q.ship_year, arg_min(fx.rate, (abs(fx.year - q.ship_year), fx.year)) AS rate, arg_min(fx.year, (abs(fx.year - q.ship_year), fx.year)) AS rate_at FROM q JOIN fx ON fx.currency = q.currency GROUP BY ALL)
SELECT l.pos, n.rate, n.rate_at FROM listings l LEFT JOIN n ON n.currency = l.currency AND n.ship_year = l.ship_year""")
def _(spark, sf):
    l = view(spark, sf, "listings").select("pos", "currency", F.col("ship_year").alias("year"))
    return joins.nearest_asof_join(l, view(spark, sf, "fx"), "currency", "year", "rate").select("pos", "rate", "rate_at")


@check("convert_currency", "listings fx", """
WITH q AS (SELECT DISTINCT currency, ship_year FROM listings),
n AS (SELECT q.currency, q.ship_year, arg_min(fx.rate, (abs(fx.year - q.ship_year), fx.year)) AS rate FROM q JOIN fx ON fx.currency = q.currency GROUP BY ALL)
SELECT l.pos, CAST(CASE WHEN l.currency = 'USD' THEN round(CAST(CAST(l.price AS VARCHAR) AS DECIMAL(38,18)), 2) ELSE round(CAST(CAST(l.price / n.rate AS VARCHAR) AS DECIMAL(38,18)), 2) END AS DOUBLE) AS usd FROM listings l LEFT JOIN n ON n.currency = l.currency AND n.ship_year = l.ship_year""")
def _(spark, sf):
    l = view(spark, sf, "listings").withColumn("currency", F.lower("currency"))
    return joins.convert_currency(l, view(spark, sf, "fx"), "price", "currency", "ship_year").select("pos", "usd")


@check("adjust_for_inflation", "listings cpi", """
SELECT pos, CAST(round(CAST(CAST(price * ((SELECT arg_max(cpi, year) FROM cpi) / c.cpi) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS adjusted FROM listings l JOIN cpi c ON c.year = least(greatest(l.year, (SELECT min(year) FROM cpi)), (SELECT max(year) FROM cpi))""")
def _(spark, sf):
    cpi = view(spark, sf, "cpi")
    return joins.adjust_for_inflation(view(spark, sf, "listings"), cpi, "price", "year", 2024).select("pos", "adjusted")


@check("clamped_lookup_join", "listings cpi", """
SELECT pos, CAST(c.cpi AS DOUBLE) AS cpi FROM listings l JOIN cpi c ON c.year = least(greatest(l.year, (SELECT min(year) FROM cpi)), (SELECT max(year) FROM cpi))""")
def _(spark, sf):
    cpi = view(spark, sf, "cpi").select(F.col("year"), F.col("cpi").cast("double").alias("v"))
    return joins.clamped_lookup_join(view(spark, sf, "listings"), cpi, "year", "v", "cpi").select("pos", "cpi")


@check("backfill_by_key", "records items", """
WITH raw AS (SELECT lower(trim(name)) AS k, arg_max(price, seq) AS p FROM records WHERE price > 0 AND year_from > 0 GROUP BY 1)
SELECT item_id, CASE WHEN size > 25 THEN price ELSE raw.p END AS price, size <= 25 AND raw.p IS NOT NULL AS backfilled FROM items LEFT JOIN raw ON raw.k = lower(trim(items.name))""")
def _(spark, sf):
    i = view(spark, sf, "items").withColumn("price", F.when(F.col("size") > 25, F.col("price")))
    raw = view(spark, sf, "records").withColumn("year", F.col("year_from"))
    return joins.backfill_by_key(i, raw, "name", "price", "seq").select("item_id", "price", "backfilled")


@check("resolve_labels", "", """
SELECT o_orderkey, c.n_name AS buyer_label, s.n_name AS seller_label FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation c ON c.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_nationkey = o_custkey % 40""")
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("c_nationkey").alias("buyer"), (F.col("o_custkey") % 40).alias("seller"))
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return joins.resolve_labels(o, ["buyer", "seller"], labels).select("o_orderkey", "buyer_label", "seller_label")


@check("label_ids", "", """
SELECT DISTINCT id FROM (SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier)""")
def _(spark, sf):
    return joins.union_ids((table(spark, sf, "customer"), ["c_nationkey"]), (table(spark, sf, "supplier"), ["s_nationkey"]))


@check("with_file", "images inventory", """
SELECT item_id, arg_min(local_path, pos) AS first_path, count(*) AS n_files FROM images WHERE local_path IN (SELECT path FROM inventory) GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "images").select("item_id", F.col("local_path").alias("path"), "pos")
    return joins.with_file(i, view(spark, sf, "inventory"), "item_id", "path", "pos")


@check("missing_entities", "items images inventory", """
SELECT item_id FROM items WHERE lower(brand) = 'brand#5' AND item_id NOT IN (SELECT item_id FROM images WHERE source = 'flickr_scrape' AND local_path IS NOT NULL AND width > 25)""")
def _(spark, sf):
    has = view(spark, sf, "images").where("source = 'flickr_scrape' and local_path is not null and width > 25")
    return joins.missing_entities(view(spark, sf, "items"), has, "item_id", "brand", "BRAND#5").select("item_id")


@check("reconcile_files", "images inventory", """
SELECT coalesce(r.path, i.path) AS path, CASE WHEN r.path IS NULL THEN 'orphan' WHEN i.path IS NULL THEN 'dangling' ELSE 'ok' END AS status
FROM (SELECT DISTINCT local_path AS path FROM images WHERE local_path IS NOT NULL) r FULL JOIN (SELECT DISTINCT path FROM inventory) i ON i.path = r.path""")
def _(spark, sf):
    refs = view(spark, sf, "images").select(F.col("local_path").alias("path"))
    return joins.reconcile(refs, view(spark, sf, "inventory"), "path")


@check("flag_has_detail", "items images", """
SELECT item_id, item_id IN (SELECT item_id FROM images WHERE bytes < 3000) AS has_detail FROM items""")
def _(spark, sf):
    return joins.flag_has_detail(view(spark, sf, "items"), view(spark, sf, "images").where("bytes < 3000"), "item_id").select("item_id", "has_detail")


@check("attach_color", "items", """
SELECT i.item_id, c.color FROM items i LEFT JOIN (SELECT s_suppkey AS k, '#' || left(md5(s_name), 6) AS color FROM supplier) c ON c.k = i.item_id""")
def _(spark, sf):
    colors = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.concat(F.lit("#"), F.left(F.md5("s_name"), F.lit(6))).alias("color"))
    return joins.lookup_join(view(spark, sf, "items"), colors, "item_id", "color", "color").select("item_id", "color")


@check("rebuild_paths", "images inventory", """
WITH f AS (SELECT path FROM inventory UNION SELECT 'p/' || CAST(item_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR) || '.png' FROM images WHERE width > 25)
SELECT item_id, pos, p AS new_path, CASE WHEN p IS NOT DISTINCT FROM local_path THEN 'unchanged' WHEN p IS NULL THEN 'cleared' ELSE 'set' END AS status FROM (
    SELECT i.item_id, i.pos, i.local_path, coalesce(a.path, b.path) AS p FROM images i LEFT JOIN f a ON a.path = i.local_path
    LEFT JOIN f b ON b.path = 'p/' || CAST(i.item_id AS VARCHAR) || '_' || CAST(i.pos AS VARCHAR) || '.png')""")
def _(spark, sf):
    i = view(spark, sf, "images").withColumn("png", F.concat(F.lit("p/"), F.col("item_id").cast("string"), F.lit("_"), F.col("pos").cast("string"), F.lit(".png"))).withColumn("jpg", F.col("local_path"))
    files = view(spark, sf, "inventory").union(i.where("width > 25").select("png"))
    return joins.rebuild_paths(i, files, "local_path", ["jpg", "png"]).select("item_id", "pos", "new_path", "status")


@check("candidate_title_match", "items", """
WITH t AS (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS n, max(title) AS title FROM (
  SELECT CASE WHEN size > 25 THEN brand || ' ' || replace(name, ' ', '-') ELSE upper(name) END AS title FROM items WHERE category <> 'PROMO') GROUP BY 1),
c AS (SELECT item_id, 1 AS pos, trim(regexp_replace(lower(brand || ' ' || name), '[^a-z0-9]+', ' ', 'g')) AS n FROM items UNION ALL SELECT item_id, 2, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) FROM items)
SELECT item_id, arg_min(title, pos) AS title FROM c JOIN t ON t.n = c.n GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "items")
    titles = i.where("category <> 'PROMO'").select(F.when(F.col("size") > 25, F.concat_ws(" ", "brand", F.translate("name", " ", "-"))).otherwise(F.upper("name")).alias("title"))
    return joins.candidate_title_match(i, titles, "item_id", "brand", "name")


@check("related_items", "items", """
SELECT item_id, CAST(rn AS INT) AS pos, related, distance FROM (
  SELECT a.item_id, b.item_id AS related, CAST(CASE WHEN a.year IS NULL OR b.year IS NULL THEN 999999 ELSE abs(a.year - b.year) END AS INT) AS distance,
    row_number() OVER (PARTITION BY a.item_id ORDER BY CASE WHEN a.year IS NULL OR b.year IS NULL THEN 999999 ELSE abs(a.year - b.year) END, b.name, b.item_id) AS rn
  FROM items a JOIN items b ON a.brand = b.brand AND a.item_id <> b.item_id) WHERE rn <= 6""")
def _(spark, sf):
    return joins.related_items(view(spark, sf, "items"), "item_id", "brand", "year", "name")


# Ratio by a row of the subsequence table per character, independent of the Spark kernel.
LCS = """list_last(list_reduce(list_prepend(list_transform(range(len(b) + 1), lambda z: 0), list_transform(string_split(a, ''), lambda ch: [CAST(unicode(ch) AS INT)])),
  lambda acc, ch: list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda i: greatest(acc[i + 1], CASE WHEN i > 0 AND unicode(b[i]) = ch[1] THEN acc[i] + 1 ELSE 0 END))))))"""


@check("fuzzy_pairs", "items", f"""
WITH t AS (SELECT brand, lower(name) AS text, min(item_id) AS id FROM items GROUP BY 1, 2),
p AS (SELECT x.brand, x.id AS id_a, y.id AS id_b, x.text AS a, y.text AS b FROM t x JOIN t y ON x.brand = y.brand AND x.id < y.id
      AND levenshtein(x.text, y.text) <= 0.205 * (length(x.text) + length(y.text)) + 0.000001),
r AS (SELECT brand, id_a, id_b, a, b, 200.0 * {LCS} / (length(a) + length(b)) AS q FROM p)
SELECT brand, id_a, id_b, a AS text_a, b AS text_b, CAST(round_even(q, 0) AS INT) AS ratio FROM r WHERE round_even(q, 0) >= 80""")
def _(spark, sf):
    i = view(spark, sf, "items").withColumn("text", F.lower("name"))
    return similarity.fuzzy_pairs(i, "brand", "text", "item_id", 80)

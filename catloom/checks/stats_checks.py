"""Aggregates, audits, ranking, layout, publishing, corrections."""

from pyspark.sql import functions as F

from catloom.checks.base import check, define, table, view
from catloom.functions import rules
from catloom.functions.values import has_amount, has_text
from catloom.operators import graph, joins, patch, rank, stats
from catloom.runtime import work_folder
from catloom.sources import files, publish
from catloom.streaming import toggles

# --- Aggregates ------------------------------------------------------------------------------


@check("coverage", "items", """
SELECT field, n, round(n * 100 / t, 1) AS pct FROM (
  SELECT count(*) AS t, unnest([{'f': 'year', 'n': count(year)}, {'f': 'fmt', 'n': count(fmt)}, {'f': 'country', 'n': count(country)}, {'f': 'description', 'n': count(*) FILTER (length(trim(description)) >= 5)}], recursive := true) FROM items) u(t, field, n)""")
def _(spark, sf):
    return stats.coverage(view(spark, sf, "items"), {
        "year": has_amount("year"), "fmt": has_text("fmt"), "country": has_text("country"), "description": ~rules.is_useless_description("description")})


@check("array_value_counts", "images", "SELECT source AS value, count(*) AS n FROM (SELECT source FROM images UNION ALL SELECT 's' || CAST(width % 4 AS VARCHAR) FROM images) GROUP BY 1")
def _(spark, sf):
    i = view(spark, sf, "images")
    return stats.array_value_counts(i, F.array("source", F.concat(F.lit("s"), (F.col("width") % 4).cast("string"))))


@check("value_counts", "items", """
SELECT coalesce(nullif(country, ''), 'Unknown') AS value, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def _(spark, sf):
    return stats.value_counts(view(spark, sf, "items"), "country")


def _item_images(spark, sf):
    """Items with their first stored image, image count and source names."""
    i = view(spark, sf, "images").where("local_path is not null")
    firsts = i.groupBy("item_id").agg(F.min_by("local_path", "pos").alias("image"), F.count("*").alias("n_images"), F.array_sort(F.collect_set("source")).alias("sources"))
    return view(spark, sf, "items").join(firsts, "item_id", "left")


define("shown", "items images", """
SELECT i.*, f.image, coalesce(f.n_images, 0) AS n_images, coalesce(f.n_sources, 0) AS n_sources, coalesce(f.scraped, false) AS scraped FROM {items} i LEFT JOIN (
  SELECT item_id, min_by(local_path, pos) AS image, count(*) AS n_images, count(DISTINCT source) AS n_sources, bool_or(source = 'flickr_scrape') AS scraped
  FROM {images} WHERE local_path IS NOT NULL GROUP BY item_id) f ON f.item_id = i.item_id
""")


@check("brand_rollup", "shown", """
SELECT brand, count(*) AS item_count, arg_min(coalesce(country, ''), item_id) AS country, arg_max(image, (h, -item_id)) AS hero_image, min(year) AS year_start, max(year) AS year_end
FROM (SELECT *, CASE WHEN scraped THEN 30 ELSE 0 END + CASE WHEN external_id IS NOT NULL THEN 10 ELSE 0 END + length(coalesce(description, '')) AS h FROM shown WHERE image IS NOT NULL)
GROUP BY brand HAVING count(*) >= 40""")
def _(spark, sf):
    s = _item_images(spark, sf)
    hero = stats.hero_score("sources", "external_id", "description", "flickr_scrape")
    return stats.brand_rollup(s, "brand", "item_id", "country", "year", "image", hero, 40)


@check("brand_items_paged", "shown", """
SELECT brand, CAST(floor((rn - 1) / 10) AS BIGINT) AS page, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (
  SELECT brand, item_id, row_number() OVER (PARTITION BY brand ORDER BY year IS NULL, year, item_id) AS rn FROM shown WHERE image IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    s = _item_images(spark, sf).where("image is not null")
    pages = rank.paged_collect(s, ["brand"], [F.col("year").isNull(), F.col("year"), F.col("item_id")], F.col("item_id"), 10, "ids")
    return pages.select("brand", "page", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@check("region_rollup", "items", """
SELECT coalesce(region, 'Other') AS region, count(DISTINCT brand) AS brand_count, count(*) AS item_count, CASE coalesce(region, 'Other') WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'Other' THEN 3 ELSE 1000000 END AS display_order FROM items GROUP BY 1""")
def _(spark, sf):
    brands = view(spark, sf, "items").groupBy("brand", F.coalesce("region", F.lit("Other")).alias("region")).agg(F.count("*").alias("item_count"))
    order = spark.createDataFrame([("ASIA", 1), ("EUROPE", 2), ("Other", 3)], "region string, ord int")
    return stats.region_rollup(brands, order)


@check("facet_options", "items", """
SELECT 'country' AS facet, country AS value FROM items WHERE country IS NOT NULL UNION SELECT 'fmt', fmt FROM items WHERE fmt IS NOT NULL
UNION SELECT 'brand', brand FROM items UNION SELECT 'decade', CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) FROM items WHERE year IS NOT NULL""")
def _(spark, sf):
    return stats.facet_options(view(spark, sf, "items"), {"country": F.col("country"), "fmt": F.col("fmt"), "brand": F.col("brand"), "decade": rules.decade("year")})


@check("group_by_decade", "items", """
SELECT brand, coalesce(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's', 'Unknown year') AS decade, coalesce(CAST(floor(year / 10) * 10 AS INT), 999999) AS sort_key, count(*) AS n FROM items GROUP BY ALL""")
def _(spark, sf):
    return stats.group_by_decade(view(spark, sf, "items"), ["brand"], "year")


@check("robust_price", "listings", """
SELECT item_id, CAST(round(CAST(CAST(median(price) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS price, count(*) AS n FROM listings WHERE currency = 'USD' AND price BETWEEN 5 AND 50000 GROUP BY item_id""")
def _(spark, sf):
    return stats.robust_price(view(spark, sf, "listings"), ["item_id"], "title", "query", "price", "currency")


@check("pricing_summary", "records", """
SELECT count(*) AS total, count(*) FILTER (price > 0) AS with_launch, count(*) FILTER (year_from > 1970) AS with_adjusted, count(*) FILTER (price > 1000) AS with_market FROM records""")
def _(spark, sf):
    r = view(spark, sf, "records").withColumn("adj", F.when(F.col("year_from") > 1970, 1.0)).withColumn("mkt", F.when(F.col("price") > 1000, F.col("price")).otherwise(F.lit(0.0)))
    return stats.pricing_summary(r, "price", "adj", "mkt")


@check("required_values", "items", """
SELECT value FROM (SELECT 'Brand#' || CAST(n_nationkey * 2 AS VARCHAR) AS value FROM nation) WHERE value NOT IN (SELECT brand FROM items)""")
def _(spark, sf):
    need = table(spark, sf, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") * 2).cast("string")).alias("value"))
    return stats.required_values_check(view(spark, sf, "items"), "brand", need)


@check("required_fragments", "items", """
SELECT unnest(['Widget', 'BOLT', 'sprocket']) AS value, unnest([bool_or(contains(lower(name), 'widget')), bool_or(contains(lower(name), 'bolt')), bool_or(contains(lower(name), 'sprocket'))]) AS present FROM items""")
def _(spark, sf):
    return stats.required_fragments_check(view(spark, sf, "items"), "name", ["Widget", "BOLT", "sprocket"])


@check("duplicate_rate", "items", """
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS dupes, round(sum(n - 1) * 100 / sum(n), 1) AS rate, sum(n - 1) * 100 / sum(n) <= 1 AS ok FROM (SELECT count(*) AS n FROM items GROUP BY lower(brand), lower(name))""")
def _(spark, sf):
    return stats.duplicate_rate(view(spark, sf, "items"), [F.lower("brand"), F.lower("name")])


@check("price_agreement", "listings items", """
SELECT count(*) AS total, count(*) FILTER (b = 'match') AS n_match, count(*) FILTER (b = 'close') AS n_close, count(*) FILTER (b = 'miss') AS n_miss, count(*) FILTER (b = 'unknown') AS n_unknown,
  round(count(*) FILTER (b = 'match') * 100 / (count(*) - count(*) FILTER (b = 'unknown')), 1) AS accuracy FROM (
  SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN p / t BETWEEN 0.7 AND 1.3 THEN 'match' WHEN p / t BETWEEN 0.5 AND 2 THEN 'close' ELSE 'miss' END AS b
  FROM (SELECT CASE WHEN l.currency <> 'EUR' THEN l.price END AS p, i.price AS t FROM listings l JOIN items i USING (item_id)))""")
def _(spark, sf):
    l = view(spark, sf, "listings").select("item_id", F.when(F.col("currency") != "EUR", F.col("price")).alias("p"))
    j = l.join(view(spark, sf, "items").select("item_id", "price"), "item_id")
    return stats.agreement_summary(j.withColumn("b", stats.amount_agreement("p", "price")), "b")


@check("label_agreement", "", """
SELECT count(*) AS total, count(*) FILTER (b = 'match') AS n_match, count(*) FILTER (b = 'close') AS n_close, count(*) FILTER (b = 'miss') AS n_miss, count(*) FILTER (b = 'unknown') AS n_unknown,
  round(count(*) FILTER (b = 'match') * 100 / (count(*) - count(*) FILTER (b = 'unknown')), 1) AS accuracy FROM (
  SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END THEN 'match' ELSE 'miss' END AS b FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.agreement_summary(d.withColumn("b", stats.label_agreement("quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0))), "b")


@check("extras_histogram", "images", """
SELECT size, count(*) AS entities FROM (SELECT item_id, count(*) FILTER (local_path IS NOT NULL AND width > 10) AS size FROM images GROUP BY 1) WHERE size > 0 GROUP BY size""")
def _(spark, sf):
    return stats.count_histogram(view(spark, sf, "images"), "item_id", F.col("local_path").isNotNull() & (F.col("width") > 10))


@check("group_audit", "blobs", """
SELECT digest, members, valid, valid = 0 AS empty, members BETWEEN 1 AND 2 AS small FROM (SELECT digest, count(*) AS members, count(*) FILTER (n_chars > 900) AS valid FROM blobs GROUP BY 1) WHERE valid = 0 OR members BETWEEN 1 AND 2""")
def _(spark, sf):
    return stats.group_audit(view(spark, sf, "blobs"), "digest", F.col("n_chars") > 900, small=2)


@check("normalization_issues", "keyed", """
SELECT seq, brand FROM (SELECT seq, part_id, CASE WHEN source_rank = 2 THEN brand WHEN part_id % 2 = 0 THEN brand ELSE brand || '.' END AS brand FROM keyed) WHERE brand LIKE '%.' AND part_id % 3 = 0""")
def _(spark, sf):
    k = view(spark, sf, "keyed").withColumn("brand", F.when((F.col("source_rank") == 2) | (F.col("part_id") % 2 == 0), F.col("brand")).otherwise(F.concat("brand", F.lit("."))))
    k = k.withColumn("normal", F.when(F.col("part_id") % 3 == 0, F.col("brand")).otherwise(F.col("canonical")))
    return stats.normalization_issues(k, "brand", "normal").select("seq", "brand")


@check("audit_summary", "items", """
SELECT count(*) AS total, count(*) FILTER (country IS NULL) AS no_country, count(*) FILTER (description IS NULL OR length(trim(description)) < 5) AS no_description, count(*) FILTER (contains(lower(name), 'red')) AS suspects FROM items""")
def _(spark, sf):
    return stats.audit_summary(view(spark, sf, "items"), {
        "no_country": ~has_text("country"), "no_description": rules.is_useless_description("description"), "suspects": rules.matches_any("name", ["red"])})


@check("source_brand_report", "images items", """
SELECT source, brand, count(*) AS n, CASE source WHEN 'flickr_scrape' THEN 1 ELSE 2 END AS risk FROM images JOIN items USING (item_id) WHERE source <> 'shop' GROUP BY ALL""")
def _(spark, sf):
    j = view(spark, sf, "images").join(view(spark, sf, "items").select("item_id", "brand"), "item_id")
    return stats.source_brand_report(j, "source", "brand", spark.createDataFrame([("flickr_scrape", 1), ("archive", 2)], "source string, ord int"))


# --- Ranking and layout ----------------------------------------------------------------------

SCORE = """
sc AS (SELECT *, least(99, CASE WHEN scraped THEN 30 ELSE 0 END + CASE WHEN external_id IS NOT NULL THEN 10 ELSE 0 END + least(greatest(n_sources - 1, 0) * 15, 30)
  + CASE WHEN length(coalesce(description, '')) > 200 THEN 15 WHEN length(coalesce(description, '')) > 150 THEN 10 WHEN length(coalesce(description, '')) > 100 THEN 5 ELSE 0 END
  + CASE WHEN brand IN ('Brand#5') THEN 5 ELSE 0 END + CASE WHEN image IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN n_images > 1 THEN 3 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 2 ELSE 0 END) AS score FROM shown),
ti AS (SELECT *, CASE WHEN image IS NULL OR size = 3 THEN 'hidden' WHEN size = 44 THEN 'xl' WHEN score = 0 THEN 'hidden' WHEN score >= 70 THEN 'l' ELSE 'm' END AS tier FROM sc)
"""


def _tiers(spark, sf):
    s = _item_images(spark, sf)
    score = rank.significance_score("sources", "external_id", "description", "brand", F.col("image").isNotNull(), F.coalesce("n_images", F.lit(0)), "year", ("brand#5",), "flickr_scrape")
    s = s.withColumn("score", score)
    shown = F.col("image").isNotNull() & (F.col("size") != 3)
    return s.withColumn("tier", rank.assign_tier(F.col("size") == 44, "score", shown, large=70))


@check("significance_score", "shown", f"WITH {SCORE} SELECT item_id, CAST(score AS INT) AS score FROM sc")
def _(spark, sf):
    return _tiers(spark, sf).select("item_id", "score")


@check("assign_tier", "shown", f"WITH {SCORE} SELECT item_id, tier FROM ti")
def _(spark, sf):
    return _tiers(spark, sf).select("item_id", "tier")


@check("tier_distribution", "shown", f"WITH {SCORE} SELECT tier, count(*) AS n FROM ti GROUP BY tier")
def _(spark, sf):
    return stats.tier_distribution(_tiers(spark, sf), "tier")


SPIRAL = """
nn AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*) + 6)) AS BIGINT) AS cols FROM part),
g AS (SELECT n, cols, CAST(ceil((n + 6) / cols) AS BIGINT) AS rws FROM nn),
h AS (SELECT *, (cols - 3) // 2 + 1 AS hc, (rws - 2) // 2 + 1 AS hr FROM g),
cc AS (SELECT *, unnest(range(1, cols + 1)) AS col FROM (SELECT *, unnest(range(1, rws + 1)) AS rw FROM h)),
s AS (SELECT *, row_number() OVER (ORDER BY rw, col) AS slot FROM cc WHERE NOT (col >= hc AND col < hc + 3 AND rw >= hr AND rw < hr + 2)),
cells AS (SELECT slot, col, rw AS row, row_number() OVER (ORDER BY sqrt((col - (hc + 1.0)) ** 2 + (rw - (hr + 0.5)) ** 2), atan2(rw - (hr + 0.5), col - (hc + 1.0)), slot) AS rank FROM s WHERE slot <= n)
"""


@check("spiral_cells", "", f"WITH {SPIRAL} SELECT slot, col, row, rank FROM cells")
def _(spark, sf):
    size = table(spark, sf, "part").agg(F.count("*").alias("n"))
    return rank.spiral_cells(size).select("slot", "col", "row", "rank")


@check("place_by_rank", "items", f"""
WITH {SPIRAL} SELECT item_id, slot, col, row FROM cells JOIN (SELECT item_id, row_number() OVER (ORDER BY size DESC, item_id) AS rank FROM items) USING (rank)""")
def _(spark, sf):
    i = view(spark, sf, "items").select("item_id", "size")
    cells = rank.spiral_cells(table(spark, sf, "part").agg(F.count("*").alias("n")))
    return rank.place_by_rank(i, cells, [F.desc("size"), F.col("item_id")]).select("item_id", "slot", "col", "row")


SPREAD = "sp AS (SELECT item_id, brand, row_number() OVER (ORDER BY t, size DESC, item_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY size DESC, item_id) AS t FROM items))"


def _spread(spark, sf):
    return rank.spread_by_group(view(spark, sf, "items"), "brand", [F.desc("size"), F.col("item_id")])


@check("spread_by_group", "items", f"WITH {SPREAD} SELECT item_id, position FROM sp")
def _(spark, sf):
    return _spread(spark, sf).select("item_id", "position")


@check("close_repeats", "items", f"""
WITH {SPREAD} SELECT b.position, b.brand, count(*) AS repeats FROM sp a JOIN sp b ON a.brand = b.brand AND b.position - a.position BETWEEN 1 AND 20 GROUP BY ALL""")
def _(spark, sf):
    return rank.close_repeats(_spread(spark, sf), "brand", "position", 20)


@check("seeded_shuffle", "items", """
SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR) || '#42'), item_id) AS position FROM items""")
def _(spark, sf):
    return rank.rank_rows(view(spark, sf, "items"), [rank.seeded_order("item_id"), F.col("item_id")], name="position").select("item_id", "position")


@check("swap_positions", "items", """
WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS position, name FROM items),
w(pair, a, b) AS (SELECT 'x' || r_name, split_part(r_name, ' ', 1), r_name FROM region UNION ALL SELECT DISTINCT 'p' || split_part(name, ' ', 1), split_part(name, ' ', 1) || ' widget 3', split_part(name, ' ', 1) || ' gear 5' FROM items),
f AS (SELECT pair, (SELECT min(position) FROM p WHERE name = a) AS pa, (SELECT min(position) FROM p WHERE name = b) AS pb FROM w),
m AS (SELECT pa AS f, pb AS t FROM f WHERE pa IS NOT NULL AND pb IS NOT NULL UNION ALL SELECT pb, pa FROM f WHERE pa IS NOT NULL AND pb IS NOT NULL)
SELECT item_id, coalesce(m.t, position) AS position FROM p LEFT JOIN m ON m.f = p.position""")
def _(spark, sf):
    i = view(spark, sf, "items").select("item_id", "name")
    first = F.split_part("name", F.lit(" "), F.lit(1))
    r = table(spark, sf, "region")
    pairs = r.select(F.concat(F.lit("x"), "r_name").alias("pair"), F.split_part("r_name", F.lit(" "), F.lit(1)).alias("a"), F.col("r_name").alias("b")).union(
        i.select(F.concat(F.lit("p"), first), F.concat(first, F.lit(" widget 3")), F.concat(first, F.lit(" gear 5"))).distinct())
    return rank.swap_positions(rank.rank_rows(i, [F.col("item_id")], name="position"), pairs, "name", "position").select("item_id", "position")


@check("work_queue", "shown", """
SELECT item_id FROM (SELECT item_id, scraped, year, name FROM shown ORDER BY NOT scraped, coalesce(year, 9999), name, item_id LIMIT 50)""")
def _(spark, sf):
    s = _item_images(spark, sf)
    scraped = F.coalesce(F.array_contains("sources", "flickr_scrape"), F.lit(False))
    return rank.work_queue(s, [~scraped, F.coalesce("year", F.lit(9999)), F.col("name"), F.col("item_id")], 50).select("item_id")


@check("batch_ids", "items", "SELECT item_id, CAST(floor((row_number() OVER (ORDER BY name, item_id) - 1) / 50) AS BIGINT) AS batch FROM items")
def _(spark, sf):
    return rank.batch_ids(view(spark, sf, "items"), [F.col("name"), F.col("item_id")], 50).select("item_id", "batch")


@check("page", "items", "SELECT item_id, name FROM items ORDER BY name, item_id LIMIT 100 OFFSET 300")
def _(spark, sf):
    return rank.page(view(spark, sf, "items"), [F.col("name"), F.col("item_id")], 3).select("item_id", "name")


@check("sample_rows", "items", "SELECT item_id, name FROM items ORDER BY md5(CAST(item_id AS VARCHAR) || '#42'), item_id LIMIT 10")
def _(spark, sf):
    return rank.sample_rows(view(spark, sf, "items"), "item_id").select("item_id", "name")


@check("cap_per_entity", "images", """
SELECT item_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM images) WHERE rn <= 8""")
def _(spark, sf):
    return rank.cap_per_entity(view(spark, sf, "images"), "item_id", [F.col("pos")], 8).select("item_id", "pos")


# --- Publishing ------------------------------------------------------------------------------


@check("read_source_records", "records", """
SELECT source AS source_name, source_rank, count(*) AS n, min(name) AS first_name, count(fmt) AS with_format, source_rank * 72057594037927936 + count(*) - 1 AS last_seq, count(*) AS places FROM records GROUP BY source, source_rank""")
def _(spark, sf):
    out = work_folder(spark)
    r = view(spark, sf, "records")
    for source in ("registry", "market", "archive"):
        rows = r.where(F.col("source") == source).select("name", F.col("brand").alias("manufacturer"), F.col("fmt").alias("film_format"), F.col("year_from").alias("year_introduced"))
        files.write_records(rows, out, source, "cameras")
    back = files.read_source_records(spark, out, ["registry", "absent", "market", "archive"], "cameras", multiline=False)
    # The source without a file keeps its rank.
    rank = F.when(F.col("source_rank") > 1, F.col("source_rank") - 1).otherwise(F.col("source_rank"))
    shift = (F.col("source_rank") - rank).cast("long") * (1 << 56)
    return back.groupBy("source_name", rank.alias("source_rank"), shift.alias("_s")).agg(
        F.count("*").alias("n"), F.min("name").alias("first_name"), F.count("film_format").alias("with_format"),
        F.max("seq").alias("_last"), F.count_distinct("seq").alias("places")
    ).select("source_name", "source_rank", "n", "first_name", "with_format", (F.col("_last") - F.col("_s")).alias("last_seq"), "places")


@check("export_landing", "items", """
SELECT 'meta' AS part, 0 AS page, count(*) AS n, 0 AS first_id FROM items UNION ALL
SELECT 'cameras', CAST(floor((rn - 1) / 500) AS BIGINT), count(*), arg_min(item_id, rn) FROM (SELECT item_id, row_number() OVER (ORDER BY name, item_id) AS rn FROM items) GROUP BY 2""")
def _(spark, sf):
    out = publish.export_landing(view(spark, sf, "items"), [F.col("name"), F.col("item_id")], ["item_id", "name", "year"], "2024-01-01T00:00:00Z", 500)
    body = F.from_json("body", "struct<total:bigint,cameras:array<struct<item_id:bigint,name:string,year:int>>>")
    return out.withColumn("b", body).select(
        "part", "page", F.coalesce("b.total", F.size("b.cameras").cast("long")).alias("n"), F.coalesce(F.col("b.cameras")[0]["item_id"], F.lit(0).cast("long")).alias("first_id"))


@check("export_detail", "items", """
SELECT left(md5(CAST(item_id AS VARCHAR)), 8) AS id, '{"name":"' || name || '"' || CASE WHEN country IS NULL THEN '' ELSE ',"country":"' || country || '"' END || CASE WHEN year IS NULL THEN '' ELSE ',"year":' || CAST(year AS VARCHAR) END || '}' AS body FROM items""")
def _(spark, sf):
    i = view(spark, sf, "items").withColumn("short", F.left(F.md5(F.col("item_id").cast("string")), F.lit(8)))
    return publish.export_detail(i, "short", ["name", "country", "year"])


@check("export_brands", "items", """
WITH b AS (SELECT brand, count(*) AS item_count, coalesce(min(region), 'Other') AS region FROM items GROUP BY 1 HAVING count(*) >= 3)
SELECT brand, region, item_count, trim(regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, page, n, first_id FROM b JOIN (
  SELECT brand, CAST(floor((rn - 1) / 25) AS BIGINT) AS page, CAST(count(*) AS INT) AS n, arg_min(item_id, rn) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY year IS NULL, year, item_id) AS rn FROM items) GROUP BY 1, 2) USING (brand)""")
def _(spark, sf):
    i = view(spark, sf, "items")
    brands = i.groupBy("brand").agg(F.count("*").alias("item_count"), F.coalesce(F.min("region"), F.lit("Other")).alias("region")).where("item_count >= 3")
    out = publish.export_brands(i, brands, "brand", [F.col("year").isNull(), F.col("year"), F.col("item_id")], ["item_id", "name"], 25)
    return out.select("brand", "region", "item_count", "slug", "page", F.size("cameras").alias("n"), F.col("cameras")[0]["item_id"].alias("first_id"))


@check("export_sitemap", "items", """
SELECT 'https://catalog.example.org' AS url, 'weekly' AS change, 1.0::DOUBLE AS priority UNION ALL SELECT 'https://catalog.example.org/brands', 'weekly', 0.9::DOUBLE
UNION ALL SELECT DISTINCT 'https://catalog.example.org/brands/' || replace(lower(brand), '#', '-'), 'monthly', 0.8::DOUBLE FROM items UNION ALL SELECT 'https://catalog.example.org/cameras/' || CAST(item_id AS VARCHAR), 'monthly', 0.7::DOUBLE FROM items""")
def _(spark, sf):
    i = view(spark, sf, "items")
    return publish.export_sitemap("https://catalog.example.org", i.select("brand").distinct(), "brand", i, "item_id")


@check("remaining_work", "items images", """
SELECT item_id, name FROM items WHERE item_id NOT IN (SELECT item_id FROM images WHERE width > 48) ORDER BY name, item_id""")
def _(spark, sf):
    done = view(spark, sf, "images").where("width > 48")
    return files.remaining_work(view(spark, sf, "items"), done, "item_id", [F.col("name"), F.col("item_id")]).select("item_id", "name")


# --- Corrections -----------------------------------------------------------------------------

define("dated", "items", """
SELECT item_id, name, brand, CASE WHEN size < 6 THEN 1850 + size ELSE year END AS start_year, CASE WHEN size > 40 THEN year - size % 7 WHEN size > 20 THEN 1998 WHEN size < 3 THEN 1899 END AS end_year, CAST(year AS STRING) AS launch, size FROM {items}
""")


@check("repair_ranges", "dated", """
SELECT item_id, rule, start_year AS old_start_year, end_year AS old_end_year,
  CASE rule WHEN 'too_early' THEN NULL WHEN 'swapped' THEN end_year ELSE start_year END AS start_year,
  CASE rule WHEN 'typo' THEN 1962 WHEN 'swapped' THEN start_year WHEN 'small_diff' THEN NULL ELSE end_year END AS end_year,
  CASE rule WHEN 'too_early' THEN NULL WHEN 'swapped' THEN CAST(end_year AS VARCHAR) ELSE launch END AS launch
FROM (SELECT *, CASE WHEN name LIKE 'blue ring%' AND brand = 'Brand#7' THEN CASE WHEN end_year IS DISTINCT FROM 1962 THEN 'typo' END
   WHEN start_year < 1880 THEN CASE WHEN NOT (name LIKE 'red%' AND brand = 'Brand#9') THEN 'too_early' END
   WHEN start_year - end_year >= 4 THEN 'swapped' WHEN start_year - end_year > 0 THEN 'small_diff' END AS rule FROM dated)""")
def _(spark, sf):
    d = view(spark, sf, "dated")
    fixes = d.where("name like 'blue ring%' and brand = 'Brand#7'").select("brand", "name", F.lit(None).cast("int").alias("start"), F.lit(1962).alias("end")).distinct()
    exempt = d.where("name like 'red%' and brand = 'Brand#9'").select("brand", "name").distinct()
    r = patch.repair_ranges(d, "brand", "name", "start_year", "end_year", "launch", fixes, exempt)
    return r.select("item_id", "rule", "old_start_year", "old_end_year", "start_year", "end_year", "launch")


@check("purge_placeholder", "records", """
SELECT seq, CASE WHEN price = 901 THEN NULL ELSE price END AS price, CASE WHEN price = 901 THEN NULL ELSE source END AS source FROM records""")
def _(spark, sf):
    return patch.purge_placeholder(view(spark, sf, "records"), "price", "source", 901.0).select("seq", "price", "source")


@check("tag_provenance", "records", """
SELECT seq, CASE WHEN price > 0 AND coalesce(fmt, '') = '' THEN 'market' ELSE fmt END AS source FROM records""")
def _(spark, sf):
    return patch.tag_provenance(view(spark, sf, "records"), "price", "fmt", "market").select("seq", F.col("fmt").alias("source"))


from catloom.checks.join_checks import BOOK_HITS  # noqa: E402

ROUND = "CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"
PRICED = f"""
{BOOK_HITS},
q AS (SELECT DISTINCT currency, year FROM price_book),
n AS (SELECT q.currency, q.year, arg_min(fx.rate, (abs(fx.year - q.year), fx.year)) AS rate FROM q JOIN fx ON fx.currency = q.currency GROUP BY ALL),
u AS (SELECT h.*, CASE WHEN h.currency = 'USD' THEN {ROUND.format(x="h.price")} ELSE {ROUND.format(x="h.price / n.rate")} END AS usd FROM hits h LEFT JOIN n ON n.currency = h.currency AND n.year = h.year WHERE rn = 1),
o AS (SELECT i.item_id, i.name, i.year, CASE WHEN u.usd IS NOT NULL THEN u.usd WHEN i.size > 25 THEN i.price END AS price_launch, CASE WHEN u.usd IS NOT NULL THEN u.currency END AS launch_currency,
  CASE WHEN u.usd IS NOT NULL THEN 'curated' WHEN u.price IS NULL AND i.size > 25 THEN 'archive' END AS launch_source, u.year AS book_year, i.size
  FROM items i LEFT JOIN u USING (item_id))
"""


def _priced(spark, sf):
    none = lambda t: F.lit(None).cast(t)
    big = F.col("size") > 25
    return view(spark, sf, "items").select(
        "item_id", "brand", "name", "year", "size", F.when(big, F.col("price")).alias("price_launch"), none("string").alias("launch_currency"), none("string").alias("launch_source"),
        F.when(F.col("size") < 9, F.lit(1.0)).otherwise(F.col("price")).alias("price_market"), F.when(F.col("size") < 20, F.lit("seed")).alias("market_source"), none("double").alias("price_adjusted"))


@check("override_from_book", "items price_book fx", f"WITH {PRICED} SELECT item_id, price_launch, launch_currency, launch_source FROM o")
def _(spark, sf):
    r = patch.override_from_book(_priced(spark, sf), view(spark, sf, "price_book"), view(spark, sf, "fx"), "item_id", "brand", "name", "price_launch", "launch_currency", "launch_source")
    return r.select("item_id", "price_launch", "launch_currency", "launch_source")


ENRICHED = f"""
{PRICED},
raw AS (SELECT lower(trim(name)) AS k, arg_max(price, seq) AS p FROM records WHERE price > 0 AND year_from > 0 GROUP BY 1),
f AS (SELECT o.*, coalesce(price_launch, 0) = 0 AND raw.p IS NOT NULL AS fill, raw.p FROM o LEFT JOIN raw ON raw.k = lower(trim(o.name))),
e AS (SELECT item_id, CASE WHEN fill THEN p ELSE price_launch END AS price_launch, CASE WHEN fill THEN 'CNY' ELSE launch_currency END AS launch_currency, CASE WHEN fill THEN 'archive' ELSE launch_source END AS launch_source,
  CASE WHEN size < 9 THEN 'purged' ELSE CASE WHEN size < 20 THEN 'seed' ELSE 'market' END END AS ms, coalesce(year, book_year) AS y FROM f),
z AS (SELECT e.*, {ROUND.format(x="price_launch * ((SELECT arg_max(cpi, year) FROM cpi) / c.cpi)")} AS price_adjusted FROM e
  LEFT JOIN cpi c ON c.year = least(greatest(e.y, (SELECT min(year) FROM cpi)), (SELECT max(year) FROM cpi)) AND e.y IS NOT NULL)
"""


def _enriched(spark, sf):
    raw = view(spark, sf, "records").withColumn("year", F.col("year_from")).withColumnRenamed("price", "price_launch")
    return patch.price_enrichment(_priced(spark, sf), view(spark, sf, "price_book"), view(spark, sf, "fx"), view(spark, sf, "cpi"), raw, 2024)


@check("price_enrichment", "items price_book fx cpi records", f"""
WITH {ENRICHED} SELECT item_id, price_launch, launch_currency, launch_source, nullif(ms, 'purged') AS market_source, CASE WHEN price_launch > 0 THEN price_adjusted END AS price_adjusted FROM z""")
def _(spark, sf):
    return _enriched(spark, sf).select("item_id", "price_launch", "launch_currency", "launch_source", "market_source", "price_adjusted")


@check("apply_inflation", "items cpi", f"""
SELECT item_id, CASE WHEN i.price > 0 AND i.year IS NOT NULL THEN {ROUND.format(x="i.price * ((SELECT cpi FROM cpi WHERE year = 1998) / c.cpi)")} END AS adjusted FROM items i
LEFT JOIN cpi c ON c.year = least(greatest(i.year, (SELECT min(year) FROM cpi)), (SELECT max(year) FROM cpi)) AND i.year IS NOT NULL""")
def _(spark, sf):
    i = view(spark, sf, "items").withColumn("adjusted", F.lit(None).cast("double")).withColumn("book_year", F.lit(None).cast("int"))
    return patch.apply_inflation(i, view(spark, sf, "cpi"), "price", "year", "adjusted", 1998).select("item_id", "adjusted")


@check("remap_values", "items countries", """
SELECT i.item_id, coalesce(f.new, i.brand) AS brand, coalesce(c.country, i.country) AS country, f.old IS NOT NULL AS remapped FROM items i
LEFT JOIN (SELECT DISTINCT brand AS old, left(brand, 7) AS new FROM items WHERE length(brand) > 7) f ON f.old = i.brand LEFT JOIN countries c ON c.canonical = f.new""")
def _(spark, sf):
    i = view(spark, sf, "items")
    fixes = i.where("length(brand) > 7").select(F.col("brand").alias("old"), F.left("brand", F.lit(7)).alias("new")).distinct()
    return patch.remap_values(i, fixes, "brand", "country", view(spark, sf, "countries")).select("item_id", "brand", "country", "remapped")


@check("fill_from_pages", "items listings", """
WITH p AS (SELECT item_id, currency, year, year + 3 AS y2 FROM listings WHERE currency <> 'EUR'),
b AS (SELECT item_id, arg_min({'f': year, 't': y2, 's': currency}, (CASE currency WHEN 'JPY' THEN 0 ELSE 1 END, year)) AS w FROM p GROUP BY 1)
SELECT i.item_id, CASE WHEN size > 25 THEN year WHEN w IS NOT NULL THEN w.f END AS year, CASE WHEN size <= 25 AND w IS NOT NULL THEN w.t ELSE year_end END AS year_end, CASE WHEN size <= 25 AND w IS NOT NULL THEN w.s END AS year_source FROM items i LEFT JOIN b USING (item_id)""")
def _(spark, sf):
    i = view(spark, sf, "items").withColumn("year", F.when(F.col("size") > 25, F.col("year")))
    pages = view(spark, sf, "listings").select("item_id", F.col("currency").alias("source"), F.col("year").alias("year_from"), (F.col("year") + 3).alias("year_to"))
    return patch.fill_from_pages(i, pages, "item_id", "year", "year_end", ["JPY", "USD"]).select("item_id", "year", "year_end", "year_source")


@check("waterfall", "images", """
SELECT item_id, arg_min(url, (n, pos)) AS url, min(n) AS source_no FROM (SELECT *, CASE source WHEN 'archive' THEN CASE WHEN width > 45 THEN 0 END WHEN 'shop' THEN CASE WHEN width > 30 THEN 1 END ELSE 2 END AS n FROM images) WHERE n IS NOT NULL GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "images")
    return patch.waterfall([i.where("source = 'archive' and width > 45"), i.where("source = 'shop' and width > 30"), i.where("source = 'flickr_scrape'")], "item_id", "url", "pos")


@check("apply_answers", "items listings", """
SELECT item_id, coalesce(a.answer, fmt) AS fmt, CASE WHEN a.answer IS NOT NULL THEN 'model' ELSE external_id END AS source FROM items LEFT JOIN (SELECT item_id, max(currency) AS answer FROM listings WHERE year > 2035 GROUP BY 1) a USING (item_id)""")
def _(spark, sf):
    answers = view(spark, sf, "listings").where("year > 2035").groupBy("item_id").agg(F.max("currency").alias("answer"))
    return patch.apply_answers(view(spark, sf, "items"), answers, "item_id", "fmt", "external_id", "model").select("item_id", "fmt", F.col("external_id").alias("source"))


@check("drop_array_items", "images", """
SELECT item_id, pos, CASE WHEN source = 'flickr_scrape' THEN 1 ELSE 0 END AS removed FROM images""")
def _(spark, sf):
    i = view(spark, sf, "images").withColumn("images", F.array(F.struct("source", "url"), F.struct(F.lit("shop").alias("source"), F.col("url"))))
    return patch.drop_array_items(i, "images", lambda x: x["source"] == "flickr_scrape").select("item_id", "pos", "removed")


@check("needs_enrichment", "items", """
SELECT item_id, size < 10 OR size = 20 AS needs_type, length(trim(coalesce(description, ''))) < 20 OR size > 40 AS needs_text FROM items""")
def _(spark, sf):
    kind = F.when(F.col("size") < 10, F.lit(" Film Camera ")).when(F.col("size") == 20, F.lit(None)).otherwise(F.col("category"))
    ratings = F.when(F.col("size") <= 40, F.lit("x"))
    return view(spark, sf, "items").select("item_id", patch.needs_type(kind).alias("needs_type"), patch.needs_text("description", ratings, 20).alias("needs_text"))


# --- Graph and collections -------------------------------------------------------------------

define("edges", "region nation supplier lineitem", """
SELECT 'r' || CAST(r_regionkey AS STRING) AS parent, 'n' || CAST(n_nationkey AS STRING) AS child FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM {supplier}
UNION ALL SELECT DISTINCT 's' || CAST(l_suppkey AS STRING), 'p' || CAST(l_partkey AS STRING) FROM {lineitem}
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'r0' FROM {supplier} WHERE s_acctbal < 1000
""")


@check("walk_tree", "edges", """
WITH w(node, depth) AS (SELECT 'r0', 0 UNION SELECT e.child, w.depth + 1 FROM w JOIN edges e ON e.parent = w.node WHERE w.depth < 3 /*recursive*/)
SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node""")
def _(spark, sf):
    roots = table(spark, sf, "region").where("r_regionkey = 0").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.walk_tree(view(spark, sf, "edges"), roots, 3)


LISTS = {"click": "favorites", "purchase": "owned", "view": "wishlist"}
FOLD = """
t AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'favorites' WHEN 'purchase' THEN 'owned' WHEN 'view' THEN 'wishlist' END AS list_name, event_id % 50 AS item_id FROM events),
m AS (SELECT user_id, list_name, item_id FROM t WHERE list_name IS NOT NULL GROUP BY ALL HAVING count(*) % 2 = 1)
"""


def _members(spark, sf):
    rows = toggles.toggle_rows(table(spark, sf, "events"), LISTS, F.col("event_id") % 50)
    return toggles.membership(toggles.fold_toggles(rows))


@check("fold_toggles", "", f"WITH {FOLD} SELECT user_id, list_name, item_id FROM m")
def _(spark, sf):
    return _members(spark, sf)


@check("collection_items", "items", f"WITH {FOLD} SELECT user_id, item_id, name FROM m JOIN items USING (item_id) WHERE list_name = 'owned'")
def _(spark, sf):
    return joins.collection_items(view(spark, sf, "items"), _members(spark, sf), "owned", "item_id").select("user_id", "item_id", "name")


@check("collection_counts", "", f"WITH {FOLD} SELECT user_id, list_name, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    return _members(spark, sf).groupBy("user_id", "list_name").agg(F.count("*").alias("n"))

"""Entity resolution and duplicates."""

from pyspark.sql import functions as F

from catloom.checks.base import check, define, table, view
from catloom.operators import dedup, rank, resolve, similarity
from catloom.plans import catalog
from catloom.runtime import cut_lineage


@check("link_by_external_id", "records", """
SELECT seq, CASE WHEN external_id IS NOT NULL THEN min(seq) OVER (PARTITION BY external_id) END AS id_leader FROM records""")
def _(spark, sf):
    return resolve.link_by_external_id(view(spark, sf, "records"), "external_id", "seq").select("seq", "id_leader")


@check("link_by_exact_key", "keyed", "SELECT seq, min(seq) OVER (PARTITION BY key) AS key_leader FROM keyed")
def _(spark, sf):
    return resolve.link_by_exact_key(view(spark, sf, "keyed"), "key", "seq").select("seq", "key_leader")


CONNECTED = """
n AS (SELECT key, min(seq) AS node FROM keyed GROUP BY key),
e AS (SELECT DISTINCT external_id AS x, node FROM keyed JOIN n USING (key) WHERE external_id IS NOT NULL),
g AS (SELECT DISTINCT a.node AS a, b.node AS b FROM e a JOIN e b USING (x)),
w(node, comp) AS (SELECT node, node FROM n UNION SELECT g.b, w.comp FROM w JOIN g ON g.a = w.node AND w.comp < g.b /*recursive*/),
c AS (SELECT node, min(comp) AS comp FROM w GROUP BY node)
"""


@check("connect_records", "keyed", f"""
WITH {CONNECTED} SELECT seq, comp AS cluster FROM keyed JOIN n USING (key) JOIN c USING (node)""")
def _(spark, sf):
    return resolve.connect(view(spark, sf, "keyed"), "key", "external_id", "seq").select("seq", "cluster")


def _clusters(spark, sf):
    """Records with the leader of their exact key."""
    return resolve.link_by_exact_key(view(spark, sf, "keyed"), "key", "seq", "cluster")


@check("survivorship", "keyed", """
WITH k AS (SELECT *, min(seq) OVER (PARTITION BY key) AS cluster FROM keyed)
SELECT cluster, min(seq) AS seq, count(*) AS n_records, arg_min(name, seq) AS name, arg_min(brand, seq) AS brand,
  arg_min(category, seq) FILTER (category <> '') AS category, arg_min(fmt, seq) FILTER (fmt <> '') AS fmt, arg_min(year_from, seq) FILTER (year_from IS NOT NULL) AS year_from,
  arg_min(price, seq) FILTER (price IS NOT NULL) AS price, arg_min(external_id, seq) FILTER (external_id <> '') AS external_id, arg_min(alt_id, seq) FILTER (alt_id <> '') AS alt_id
FROM k GROUP BY cluster""")
def _(spark, sf):
    return resolve.survivorship(_clusters(spark, sf), "cluster", "seq", ["category", "fmt", "year_from", "price", "external_id", "alt_id"], ["name", "brand"])


@check("first_identifier", "keyed", """
WITH k AS (SELECT *, min(seq) OVER (PARTITION BY key) AS cluster FROM keyed)
SELECT cluster, arg_min(external_id, seq) FILTER (external_id <> '') AS external_id, arg_min(alt_id, seq) FILTER (alt_id <> '') AS alt_id FROM k GROUP BY cluster""")
def _(spark, sf):
    return resolve.first_identifier(_clusters(spark, sf), "cluster", "seq", ["external_id", "alt_id"])


def _image_records(spark, sf):
    """One record per line item: its item is the cluster, its images are the file and a shared view."""
    i = view(spark, sf, "images")
    two = F.array(
        F.struct(F.concat(F.lit("u"), (F.col("width") % 9).cast("string")).alias("url"), F.col("source")),
        F.struct(F.concat(F.lit("u"), (F.col("supplier_id") % 5).cast("string")).alias("url"), F.lit("second").alias("source")))
    refs = F.array(F.struct(F.col("source"), F.when(F.col("width") > 20, F.col("width").cast("string")).alias("source_id")))
    return i.select("item_id", "pos", two.alias("images"), refs.alias("sources"))


UNION_IMAGES = """
WITH r AS (SELECT item_id, pos, 0 AS p, 'u' || CAST(width % 9 AS VARCHAR) AS url, source FROM images UNION ALL SELECT item_id, pos, 1, 'u' || CAST(supplier_id % 5 AS VARCHAR), 'second' FROM images),
b AS (SELECT item_id, min(pos) AS base FROM images GROUP BY 1),
f AS (SELECT item_id, url, arg_min(pos, (pos, p)) AS first_seq, arg_min(p, (pos, p)) AS first_pos, arg_min(source, (pos, p)) AS s FROM r GROUP BY 1, 2),
l AS (SELECT r.item_id, url, arg_max(source, p) AS s FROM r JOIN b ON r.item_id = b.item_id AND pos = base GROUP BY 1, 2)
SELECT f.item_id, f.first_seq, CAST(f.first_pos AS INT) AS first_pos, f.url, coalesce(l.s, f.s) AS source FROM f LEFT JOIN l USING (item_id, url)"""


@check("union_images", "images", UNION_IMAGES)
def _(spark, sf):
    return resolve.union_values(_image_records(spark, sf), "item_id", "pos", "images", ["url"]).select("item_id", "first_seq", "first_pos", "element.url", "element.source")


@check("union_sources", "images", """
SELECT item_id, min(pos) AS first_seq, source, CASE WHEN width > 20 THEN CAST(width AS VARCHAR) END AS source_id FROM images GROUP BY item_id, source, 4""")
def _(spark, sf):
    u = resolve.union_values(_image_records(spark, sf), "item_id", "pos", "sources", ["source", "source_id"], last_in_base=False)
    return u.select("item_id", "first_seq", "element.source", "element.source_id")


@check("union_images_paged", "images", UNION_IMAGES.replace("SELECT f.item_id, f.first_seq,", "SELECT item_id, CAST(floor((rn - 1) / 4) AS BIGINT) AS page, string_agg(url, ',' ORDER BY rn) AS urls FROM (SELECT f.item_id, row_number() OVER (PARTITION BY f.item_id ORDER BY f.first_seq, f.first_pos) AS rn, f.first_seq,") + ") GROUP BY item_id, page")
def _(spark, sf):
    u = resolve.union_values(_image_records(spark, sf), "item_id", "pos", "images", ["url"])
    pages = rank.paged_collect(u, ["item_id"], [F.col("first_seq"), F.col("first_pos")], F.col("element.url"), 4, "urls")
    return pages.select("item_id", "page", F.array_join("urls", ",").alias("urls"))


FUZZY = """
t AS (SELECT brand, lower(name) AS text, min(item_id) AS id FROM items GROUP BY 1, 2),
p AS (SELECT x.id AS a, y.id AS b, x.text AS ta, y.text AS tb FROM t x JOIN t y ON x.brand = y.brand AND x.id < y.id
      AND levenshtein(x.text, y.text) <= 0.205 * (length(x.text) + length(y.text)) + 0.000001)
"""


def _pairs(spark, sf):
    i = view(spark, sf, "items").withColumn("text", F.lower("name"))
    return similarity.fuzzy_pairs(i, "brand", "text", "item_id", 80)


from catloom.checks.join_checks import LCS as _LCS  # noqa: E402

SCORED = "r AS (SELECT a AS id_a, b AS id_b, ta, tb, CAST(round_even(200.0 * " + _LCS.replace("string_split(a,", "string_split(ta,").replace("len(b)", "len(tb)").replace("b[i]", "tb[i]") + " / (length(ta) + length(tb)), 0) AS INT) AS ratio FROM p)"


@check("review_queue", "items", f"WITH {FUZZY}, {SCORED} SELECT id_a, id_b, ratio FROM r WHERE ratio >= 80 AND ratio < 90")
def _(spark, sf):
    return resolve.review_queue(_pairs(spark, sf)).select("id_a", "id_b", "ratio")


# The greedy clustering record by record: one leads unless a smaller neighbour leads. {m} holds the pairs to merge.
GREEDY = """
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn, list(a) FILTER (a IS NOT NULL) AS smaller
  FROM (SELECT id_b AS id, id_a AS a FROM m UNION ALL SELECT id_a, NULL FROM m) GROUP BY id),
grown(rn, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o.rn, CASE WHEN list_has_any(coalesce(o.smaller, []), grown.leaders) THEN grown.leaders ELSE list_append(grown.leaders, o.id) END FROM grown JOIN o ON o.rn = grown.rn + 1 /*recursive*/),
l AS (SELECT unnest(leaders) AS id FROM (SELECT leaders FROM grown ORDER BY rn DESC LIMIT 1)),
s AS (SELECT id_b AS member, min(id_a) AS leader FROM m WHERE id_a IN (SELECT id FROM l) AND id_b NOT IN (SELECT id FROM l) GROUP BY 1)
"""


@check("fuzzy_cluster", "items", f"""
WITH {FUZZY}, {SCORED}, m AS MATERIALIZED (SELECT id_a, id_b FROM r WHERE ratio >= 90 AND length(ta) > 3 AND length(tb) > 3), {GREEDY} SELECT member, leader FROM s""")
def _(spark, sf):
    return resolve.fuzzy_cluster(resolve.merge_ready(_pairs(spark, sf)))


@check("cluster_id", "keyed", """
SELECT DISTINCT key, left(md5(key), 8) || '-' || substr(md5(key), 9, 4) || '-' || substr(md5(key), 13, 4) || '-' || substr(md5(key), 17, 4) || '-' || substr(md5(key), 21) AS id FROM keyed""")
def _(spark, sf):
    return view(spark, sf, "keyed").select("key").distinct().withColumn("id", resolve.cluster_id("key"))


def _full_records(spark, sf):
    """The record view with the columns of the item schema."""
    r = view(spark, sf, "records")
    none = lambda t: F.lit(None).cast(t)
    return r.select(
        "seq", "name", F.col("brand").alias("manufacturer"), F.col("external_id").alias("wikidata_qid"), F.col("alt_id").alias("flickr_id"),
        F.col("category").alias("camera_type"), F.col("fmt").alias("film_format"), F.col("year_from").alias("year_introduced"),
        none("int").alias("year_discontinued"), none("string").alias("launch_date"), none("string").alias("lens_mount"),
        none("string").alias("shutter_speed_range"), none("string").alias("metering"), none("int").alias("weight_g"), none("string").alias("dimensions"),
        none("string").alias("battery"), none("string").alias("description"), none("string").alias("manufacturer_country"),
        F.col("price").alias("price_launch_usd"), none("double").alias("price_adjusted_usd"), none("double").alias("price_market_usd"),
        F.array(F.struct(F.concat(F.lit("u"), "part_id").alias("url"), "source")).alias("images"),
        F.array(F.struct("source", "source_id")).alias("sources"))


# The whole merge: exact links, similar heads of clusters in a brand, greedy clusters, then the first value of each field.
MERGED = f"""
{CONNECTED},
k AS (SELECT keyed.*, comp, min(seq) OVER (PARTITION BY key) AS kl, CASE WHEN external_id <> '' THEN min(seq) OVER (PARTITION BY external_id) END AS il
  FROM keyed JOIN n USING (key) JOIN c USING (node)),
t AS (SELECT comp AS id, arg_min(lower(canonical), seq) AS brand, arg_min(lower(replace(name, '  ', ' ')), seq) AS text FROM k GROUP BY comp),
p AS (SELECT x.id AS a, y.id AS b, x.text AS ta, y.text AS tb FROM t x JOIN t y ON x.brand = y.brand AND x.id < y.id
      AND levenshtein(x.text, y.text) <= 0.205 * (length(x.text) + length(y.text)) + 0.000001),
{SCORED},
m AS MATERIALIZED (SELECT id_a, id_b FROM r WHERE ratio >= 90 AND length(ta) > 3 AND length(tb) > 3),
{GREEDY},
f AS (SELECT k.*, coalesce(leader, comp) AS cluster FROM k LEFT JOIN s ON member = comp)
"""
ID = "left(md5({k}), 8) || '-' || substr(md5({k}), 9, 4) || '-' || substr(md5({k}), 13, 4) || '-' || substr(md5({k}), 17, 4) || '-' || substr(md5({k}), 21)"


@check("merged_catalog", "keyed countries", f"""
WITH {MERGED},
best AS (SELECT cluster, count(*) AS n_records, arg_min(key, seq) AS key, arg_min(name, seq) AS name, arg_min(canonical, seq) AS canonical,
  arg_min(fmt, seq) FILTER (fmt <> '') AS fmt, arg_min(year_from, seq) FILTER (year_from IS NOT NULL) AS year FROM f GROUP BY cluster)
SELECT {ID.format(k="key")} AS id, name, best.canonical AS manufacturer_normalized, CASE fmt WHEN '35 mm' THEN '135' WHEN 'large format' THEN '4x5' END AS film_format,
  CAST(nullif(year, 0) AS VARCHAR) AS launch_date, country AS manufacturer_country, n_records FROM best LEFT JOIN countries ON countries.canonical = best.canonical""")
def _(spark, sf):
    items, _ = _merge(spark, sf)
    return items.select("id", "name", "manufacturer_normalized", "film_format", "launch_date", "manufacturer_country", "n_records")


def _merge(spark, sf, stats=None):
    from catloom.vocabulary import NAME_PREFIXES
    prefixes = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(NAME_PREFIXES)], "ord int, prefix string, brand string")
    return catalog.merge_items(_full_records(spark, sf), view(spark, sf, "aliases"), prefixes, view(spark, sf, "countries"), stats)


# Some records say that they are digital or a military item, so that both filters have work.
@check("merge_stats", "keyed", f"""
WITH {MERGED},
marks AS (SELECT coalesce(arg_min(d, seq) FILTER (d <> ''), '') <> '' AS nr, coalesce(lower(arg_min(c, seq) FILTER (c <> '')) LIKE '%digital%', false) AS tech
  FROM (SELECT *, CASE WHEN part_id % 7 = 0 THEN 'Made for aerial reconnaissance.' END AS d, CASE WHEN part_id % 5 = 0 THEN 'Digital camera' ELSE category END AS c FROM f) GROUP BY cluster),
i AS (SELECT count(*) AS total_input, count(*) FILTER (il < seq) AS id_matches, count(*) FILTER (NOT coalesce(il < seq, false) AND kl < seq) AS exact_matches, count(DISTINCT cluster) AS clusters FROM f),
d AS (SELECT count(*) FILTER (nr) AS non_retail_filtered, count(*) FILTER (NOT nr AND tech) AS tech_filtered FROM marks)
SELECT total_input, id_matches, exact_matches, (SELECT count(*) FROM r WHERE ratio >= 80 AND ratio < 90 AND length(ta) > 3) AS review_queue_size, (SELECT count(*) FROM s) AS fuzzy_matches,
  non_retail_filtered, tech_filtered, clusters - non_retail_filtered - tech_filtered AS total_output, round((1 - clusters / total_input) * 100, 1) AS dedup_rate FROM i, d""")
def _(spark, sf):
    stats = resolve.MergeStats()
    r = _full_records(spark, sf)
    part = F.substring(F.element_at("images", 1)["url"], 2, 20).cast("long")
    r = r.withColumn("description", F.when(part % 7 == 0, F.lit("Made for aerial reconnaissance.")).cast("string"))
    r = r.withColumn("camera_type", F.when(part % 5 == 0, F.lit("Digital camera")).otherwise(F.col("camera_type")))
    from catloom.vocabulary import NAME_PREFIXES
    prefixes = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(NAME_PREFIXES)], "ord int, prefix string, brand string")
    items, _ = catalog.merge_items(r, view(spark, sf, "aliases"), prefixes, view(spark, sf, "countries"), stats)
    cut_lineage(items.select("id"))
    return stats.frame(spark)


@check("merged_films", "keyed", f"""
WITH {MERGED}
SELECT {ID.format(k="arg_min(key, seq)")} AS id, arg_min(name, seq) AS name, arg_min(category, seq) FILTER (category <> '') AS film_type,
  arg_min(CAST(part_id % 4 * 100 AS INT), seq) AS iso_speed, CAST(nullif(arg_min(year_from, seq) FILTER (year_from IS NOT NULL), 0) AS VARCHAR) AS launch_date,
  count(*) AS n_records FROM f GROUP BY cluster""")
def _(spark, sf):
    r = view(spark, sf, "records")
    none = lambda t: F.lit(None).cast(t)
    films = r.select(
        "seq", "name", F.col("brand").alias("manufacturer"), F.col("external_id").alias("wikidata_qid"), F.col("category").alias("film_type"),
        (F.col("part_id") % 4 * 100).cast("int").alias("iso_speed"), F.array(F.col("fmt")).alias("available_formats"), (F.col("source_rank") == 0).alias("is_current"),
        F.col("year_from").alias("year_introduced"), none("int").alias("year_discontinued"), none("string").alias("launch_date"),
        none("string").alias("grain"), none("string").alias("color_rendition"), none("string").alias("description"),
        F.array(F.struct(F.concat(F.lit("u"), "part_id").alias("url"), "source")).alias("images"), F.array(F.struct("source", "source_id")).alias("sources"))
    merged, _ = catalog.merge_films(films, view(spark, sf, "aliases"))
    return merged.select("id", "name", "film_type", "iso_speed", "launch_date", "n_records")


# --- Duplicates ------------------------------------------------------------------------------


@check("keep_first", "records", """
SELECT seq, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS rn FROM records) WHERE rn = 1""")
def _(spark, sf):
    return dedup.keep_first(view(spark, sf, "records"), "name", "seq").select("seq", "name")


@check("keep_richest", "images", """
SELECT item_id, pos, width FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY width DESC, pos) AS rn FROM images) WHERE rn = 1""")
def _(spark, sf):
    return dedup.keep_richest(view(spark, sf, "images"), "item_id", "width", "pos").select("item_id", "pos", "width")


@check("append_seed_rows", "items records", """
SELECT name, brand FROM items WHERE category <> 'PROMO' UNION ALL
SELECT name, brand FROM records WHERE source_rank = 1 AND lower(name) NOT IN (SELECT lower(name) FROM items WHERE category <> 'PROMO')""")
def _(spark, sf):
    base = view(spark, sf, "items").where("category <> 'PROMO'").select("name", "brand")
    return dedup.append_seed_rows(base, view(spark, sf, "records").where("source_rank = 1").select("name", "brand"), "name")


@check("union_with_seen", "records", """
SELECT seq, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE source_rank WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, seq) AS rn FROM records) WHERE rn = 1""")
def _(spark, sf):
    r = view(spark, sf, "records")
    return dedup.union_with_seen([r.where(f"source_rank = {k}") for k in (2, 0, 1)], "name", "seq").select("seq", "name")


@check("id_set_ops", "", """
WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 2000)
SELECT 'union' AS op, id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
SELECT 'difference', id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersection', id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def _(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("id"))
    return dedup.id_set_ops(a, b, "id")


@check("drop_shared_values", "blobs", """
SELECT doc_id FROM blobs WHERE NOT (lang = 'en' AND digest IN (SELECT digest FROM blobs WHERE lang = 'en' GROUP BY digest HAVING count(DISTINCT doc_id) > 1))""")
def _(spark, sf):
    return dedup.drop_shared_values(view(spark, sf, "blobs"), "doc_id", "digest", F.col("lang") == "en").select("doc_id")


HASHED = """
g AS (SELECT digest, count(*) AS size, CASE WHEN count(DISTINCT grp) > 1 THEN 'cross-brand duplicate' WHEN count(DISTINCT doc_id) > 1 THEN 'same-brand duplicate' ELSE 'copy' END AS kind,
  count(DISTINCT grp) > 1 OR (count(DISTINCT doc_id) > 1 AND (bool_or(lang IN ('fr', 'de')) OR count(*) > 2)) AS flagged FROM blobs GROUP BY digest HAVING count(*) > 1)
"""


def _groups(spark, sf):
    return dedup.hash_duplicate_groups(view(spark, sf, "blobs"), "digest", "grp", "doc_id", "lang", ("fr", "de"))


@check("hash_duplicate_groups", "blobs", f"WITH {HASHED} SELECT digest, size, kind, flagged FROM g")
def _(spark, sf):
    return _groups(spark, sf)


@check("flag_hash_duplicates", "blobs", f"WITH {HASHED} SELECT b.doc_id, g.kind AS reason FROM blobs b JOIN g USING (digest) WHERE flagged")
def _(spark, sf):
    return dedup.flag_hash_duplicates(view(spark, sf, "blobs"), _groups(spark, sf), "digest").select("doc_id", "reason")


@check("validate_extras", "blobs", """
WITH m AS (SELECT * FROM blobs WHERE lang = 'en'), e AS (SELECT * FROM blobs WHERE NOT (lang = 'en' AND n_chars > 500)),
f AS (SELECT e.*, CASE WHEN e.n_chars < 300 THEN 'tiny' WHEN EXISTS (SELECT 1 FROM m WHERE m.digest = e.digest AND m.grp = e.grp) THEN 'own_main' WHEN EXISTS (SELECT 1 FROM m WHERE m.digest = e.digest) THEN 'other_main' END AS r FROM e)
SELECT doc_id, coalesce(r, CASE WHEN count(*) FILTER (r IS NULL) OVER (PARTITION BY digest) > 1 THEN 'mass' ELSE 'kept' END) AS reason FROM f""")
def _(spark, sf):
    b = view(spark, sf, "blobs")
    mains, extras = b.where("lang = 'en'"), b.where("not (lang = 'en' and n_chars > 500)")
    return dedup.validate_extras(mains, extras, "grp", "digest", "n_chars", min_size=300, mass=1).select("doc_id", "reason")


@check("unreliable_flags", "blobs", f"""
WITH {HASHED} SELECT doc_id, arg_min(reason, (prio, reason)) AS reason FROM (
  SELECT b.doc_id, g.kind AS reason, 0 AS prio FROM blobs b JOIN g USING (digest) WHERE flagged
  UNION ALL SELECT doc_id, 'unreliable source (' || lang || ')', 1 FROM blobs WHERE lang IN ('fr', 'de') UNION ALL SELECT doc_id, 'tiny file', 2 FROM blobs WHERE n_chars < 200) GROUP BY doc_id""")
def _(spark, sf):
    b = view(spark, sf, "blobs")
    dupes = dedup.flag_hash_duplicates(b, _groups(spark, sf), "digest")
    weak = b.where(F.col("lang").isin("fr", "de")).withColumn("reason", F.concat(F.lit("unreliable source ("), "lang", F.lit(")")))
    tiny = b.where("n_chars < 200").withColumn("reason", F.lit("tiny file"))
    return dedup.first_reason([dupes, weak, tiny], "doc_id")


define("misfiled", "listings", """
SELECT item_id, pos, brand, replace(split_part(query, ' ', 2), ' ', '-') AS own_model,
  'https://x.example.org/images/' || CASE currency WHEN 'USD' THEN brand WHEN 'JPY' THEN 'Old-' || brand ELSE 'Other' END || '-' || CASE WHEN year > 2010 THEN replace(split_part(query, ' ', 2), ' ', '-') ELSE 'model-AB-' || CAST(year AS STRING) END || '.jpg' AS url
FROM {listings}
""")


def _misfiled(spark, sf):
    m = view(spark, sf, "misfiled")
    brands = m.select("brand").distinct()
    prefixes = brands.select("brand", F.col("brand").alias("prefix"), F.lit(0).alias("ord")).union(brands.select("brand", F.concat(F.lit("Old-"), "brand"), F.lit(1)))
    return dedup.split_misplaced(m, prefixes, "url", "brand", "own_model")


@check("split_misplaced", "misfiled", """
SELECT item_id, pos, CASE WHEN regexp_extract(url, '#\\d+-(.*)\\.jpg', 1) = own_model THEN 'correct' ELSE 'misplaced' END AS status, regexp_extract(url, '#\\d+-(.*)\\.jpg', 1) AS model
FROM misfiled WHERE url NOT LIKE '%/Other-%'""")
def _(spark, sf):
    return _misfiled(spark, sf).select("item_id", "pos", "status", "model")


@check("relocate_or_create", "misfiled items", """
WITH w AS (SELECT DISTINCT brand, regexp_replace(replace(regexp_extract(url, '#\\d+-(.*)\\.jpg', 1), '-', ' '), '\\b([A-Z]{1,3}) (\\d)', '\\1-\\2', 'g') AS new_name, url FROM misfiled
           WHERE url NOT LIKE '%/Other-%' AND regexp_extract(url, '#\\d+-(.*)\\.jpg', 1) <> own_model),
c AS (SELECT lower(brand) || '|' || 'model ab-' || CAST(1991 + size AS VARCHAR) AS k, max(item_id) AS id FROM items WHERE size < 10 GROUP BY 1)
SELECT coalesce(CAST(c.id AS VARCHAR), regexp_replace(md5(lower(brand) || '|' || lower(new_name)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')) AS target_id,
  CASE WHEN c.id IS NULL THEN 'created' ELSE 'existing' END AS status, brand, new_name, url FROM w LEFT JOIN c ON c.k = lower(brand) || '|' || lower(new_name)""")
def _(spark, sf):
    cat = view(spark, sf, "items").where("size < 10").withColumn("title", F.concat(F.lit("Model AB-"), (F.col("size") + 1991).cast("string")))
    bad = _misfiled(spark, sf).where("status = 'misplaced'")
    return dedup.relocate_or_create(bad, cat, "brand", "model", "url", "item_id", "title")


@check("plan_targets", "images", """
SELECT local_path AS path, 'f/' || CAST(item_id AS VARCHAR) || '/' || CASE WHEN rn = 1 THEN 'main' ELSE CAST(rn AS VARCHAR) END || '.jpg' AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM images WHERE local_path IS NOT NULL)""")
def _(spark, sf):
    files = view(spark, sf, "images").where("local_path is not null").withColumn("folder", F.concat(F.lit("f/"), F.col("item_id").cast("string")))
    return dedup.plan_targets(files, "folder", "local_path", [F.col("pos")]).select(F.col("local_path").alias("path"), "target")


@check("plan_orphan_targets", "images", """
SELECT path, '_orphans/' || CASE WHEN rn = 1 THEN leaf ELSE regexp_replace(leaf, '\\.[^.]+$', '') || '_dup' || CAST(rn AS VARCHAR) || '.jpg' END AS target FROM (
  SELECT path, leaf, row_number() OVER (PARTITION BY leaf ORDER BY path) AS rn FROM (
    SELECT local_path AS path, regexp_extract(local_path, '([^/]+)$', 1) AS leaf FROM (SELECT replace(local_path, '_', '/_') AS local_path FROM images WHERE local_path IS NOT NULL)))""")
def _(spark, sf):
    files = view(spark, sf, "images").where("local_path is not null").select(F.replace("local_path", F.lit("_"), F.lit("/_")).alias("path"))
    return dedup.plan_orphan_targets(files, "path", "_orphans").select("path", "target")


@check("claim_orphans", "images", """
WITH p AS (SELECT regexp_replace(regexp_extract(local_path, '([^/]+)$', 1), '_\\d+\\.jpg$', '') AS stem, min(item_id) AS owner FROM images WHERE local_path IS NOT NULL AND width > 20 GROUP BY 1)
SELECT local_path AS path, owner AS item_id, CAST(regexp_extract(local_path, '_(\\d+)\\.jpg$', 1) AS INT) AS number FROM images JOIN p ON p.stem = regexp_replace(regexp_extract(local_path, '([^/]+)$', 1), '_\\d+\\.jpg$', '') WHERE local_path IS NOT NULL AND width <= 20""")
def _(spark, sf):
    i = view(spark, sf, "images").where("local_path is not null")
    primaries = i.where("width > 20").select("item_id", F.regexp_replace("local_path", r"_\d+\.jpg$", ".jpg").alias("path"))
    return dedup.claim_orphans(i.where("width <= 20").select(F.col("local_path").alias("path")), primaries, "path", "item_id").select("path", "item_id", "number")

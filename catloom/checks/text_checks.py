"""Name, path, URL and parsing scalars."""

from pyspark.sql import functions as F

from catloom.checks.base import check, define, table, view
from catloom.functions import parse, text
from catloom.operators import joins


@check("normalize_name", "records", """
SELECT seq, regexp_replace(trim(lower(name || ' ® ')), '\\s+', ' ', 'g').replace('®', '') AS normalized FROM records""")
def _(spark, sf):
    r = view(spark, sf, "records")
    return r.select("seq", text.normalize_name(F.concat("name", F.lit(" ® "))).alias("normalized"))


@check("normalize_alias", "records aliases", """
SELECT seq, coalesce(a.canonical, b.canonical, replace(r.brand, ' Inc.', '')) AS brand_canonical
FROM records r LEFT JOIN aliases a ON a.alias = lower(r.brand)
LEFT JOIN aliases b ON b.alias = lower(replace(r.brand, ' Inc.', ''))""")
def _(spark, sf):
    r = joins.normalize_alias(view(spark, sf, "records"), "brand", view(spark, sf, "aliases"))
    return r.select("seq", "brand_canonical")


@check("make_key", "keyed", "SELECT seq, key FROM keyed")
def _(spark, sf):
    r = joins.normalize_alias(view(spark, sf, "records"), "brand", view(spark, sf, "aliases"))
    return r.select("seq", joins.make_key("brand_canonical", "name").alias("key"))


@check("match_keys", "records", """
SELECT seq, trim(regexp_replace(lower(brand || '--' || name), '[^a-z0-9]+', ' ', 'g')) AS spaced,
       regexp_replace(lower(brand || '--' || name), '[^a-z0-9]', '', 'g') AS compact FROM records""")
def _(spark, sf):
    c = F.concat("brand", F.lit("--"), "name")
    return view(spark, sf, "records").select(
        "seq", text.match_key_spaced(c).alias("spaced"), text.match_key_compact(c).alias("compact"))


@check("strip_accents", "", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_accents("text")).alias("folded"))


@check("fold_unicode", "", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_unicode("text")).alias("folded"))


@check("safe_path", "records", """
SELECT seq, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace('_' || brand || ' / ' || name || '?.', '[<>:"/\\\\|?*]', '_', 'g'),
       '[\\s_]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 200), ''), 'unknown') AS path FROM records""")
def _(spark, sf):
    c = F.concat(F.lit("_"), "brand", F.lit(" / "), "name", F.lit("?."))
    return view(spark, sf, "records").select("seq", text.safe_path(c).alias("path"))


@check("slug", "records", """
SELECT seq, trim(regexp_replace(lower(brand || ' ' || name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM records""")
def _(spark, sf):
    return view(spark, sf, "records").select("seq", text.slug(F.concat_ws(" ", "brand", "name")).alias("slug"))


@check("display_name", "keyed", """
SELECT seq, CASE WHEN starts_with(lower(n), lower(canonical)) THEN n ELSE canonical || ' ' || n END AS display
FROM (SELECT seq, canonical, CASE WHEN source_rank = 1 THEN brand || ' ' || name ELSE name END AS n FROM keyed)""")
def _(spark, sf):
    name = F.when(F.col("source_rank") == 1, F.concat_ws(" ", "brand", "name")).otherwise(F.col("name"))
    return view(spark, sf, "keyed").select("seq", text.display_name("canonical", name).alias("display"))


@check("short_id", "items", """
SELECT item_id, left(md5(CAST(item_id AS VARCHAR)), 8) AS short_id FROM items""")
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", text.short_id(F.md5(F.col("item_id").cast("string")), "name").alias("short_id"))


@check("short_id_collisions", "items", """
SELECT left(md5(CAST(item_id AS VARCHAR)), 3) AS short, count(*) AS n, min(item_id) AS first, max(item_id) AS last
FROM items GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    from catloom.sources.publish import id_collisions
    short = text.short_id(F.md5(F.col("item_id").cast("string")), "name", width=3)
    return id_collisions(view(spark, sf, "items").withColumn("short", short), "short", "item_id")


@check("image_paths", "images", """
SELECT pos, replace(local_path, 'data/images/', '') AS web, regexp_replace(local_path, '/[^/]+$', '/thumb.webp') AS thumb
FROM images""")
def _(spark, sf):
    return view(spark, sf, "images").select("pos", text.web_path("local_path").alias("web"), text.thumb_url("local_path").alias("thumb"))


@check("url_extension", "", """
SELECT page_id, CASE WHEN e IN ('jpg','jpeg','png','gif','webp','tif','tiff') THEN e ELSE 'jpg' END AS page_ext,
       CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS file_ext
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.(\\w{2,5})$', 1)) AS e FROM pages)""")
def _(spark, sf):
    made = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit("/x.PNG")).otherwise(F.lit("/x.exe")))
    plain = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.regexp_replace(made, r"^.*/x", "/x"), F.lit("?v=1#top"))
    return table(spark, sf, "pages").select("page_id", text.extension("url").alias("page_ext"), text.extension(plain).alias("file_ext"))


@check("name_from_slug", "items", """
SELECT item_id, regexp_replace(replace(s, '-', ' '), '\\b([A-Z]{1,3}) (\\d)', '\\1-\\2', 'g') AS name
FROM (SELECT item_id, replace(upper(left(name, 2)) || '-' || name, ' ', '-') AS s FROM items)""")
def _(spark, sf):
    s = F.translate(F.concat(F.upper(F.left("name", F.lit(2))), F.lit("-"), F.col("name")), " ", "-")
    return view(spark, sf, "items").select("item_id", text.name_from_slug(s).alias("name"))


@check("strip_marketing_terms", "items", """
SELECT item_id, brand || ' ' || regexp_replace(name, '\\s+\\d+$', '') || ' Deluxe ' || CAST(size AS VARCHAR) AS name FROM items""")
def _(spark, sf):
    raw = F.concat(F.lit(" "), "brand", F.lit(" "), F.regexp_replace("name", r"\s+\d+$", ""), F.lit("35 mm Film Camera Deluxe  "),
                   F.col("size").cast("string"), F.lit(" Film Camera Glass Lens"))
    return view(spark, sf, "items").select("item_id", text.strip_marketing_terms(raw).alias("name"))


@check("build_query", "records", """
SELECT seq, CASE WHEN length(q) >= 5 THEN q END AS query FROM (
SELECT seq, trim(regexp_replace(strip_accents(brand || ' ' || name || ' é'), '\\s+', ' ', 'g')) AS q FROM records)""")
def _(spark, sf):
    name = F.concat("name", F.lit(" (mark II)"), F.lit("  é"))
    return view(spark, sf, "records").select("seq", text.build_query("brand", name).alias("query"))


@check("query_variants", "items", """
SELECT item_id, pos - 1 AS pos, v AS variant FROM (
  SELECT item_id, unnest(q) AS v, generate_subscripts(q, 1) AS pos FROM (
    SELECT item_id, CASE WHEN size % 5 = 0
      THEN ['Fuji ' || m, 'Fuji ' || h, 'Fujifilm ' || m, 'Fujica ' || m, m]
      ELSE [brand || ' ' || m, brand || ' ' || h, m] END AS q
    FROM (SELECT item_id, brand, size, name AS m, regexp_replace(name, '(\\D)\\s+(\\d)', '\\1-\\2') AS h FROM items)))""")
def _(spark, sf):
    brand = F.when(F.col("size") % 5 == 0, F.lit("Fuji")).otherwise(F.col("brand"))
    base = F.when(F.col("size") % 5 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" (old)")))
    return view(spark, sf, "items").select("item_id", F.posexplode(text.query_variants(brand, base)).alias("pos", "variant"))


define("infoboxes", "items", """
SELECT item_id, name, brand, category, size, year, '[[' || brand || '|' || name || ']] ''''''' || category || ''''''' {{{{nowrap|' || CAST(size AS STRING) || ' g}}}}<ref>x</ref>&nbsp;&ndash; [[' || category || ']]{{{{cite|1}}}}' AS markup
FROM {items}
""")


@check("clean_markup", "infoboxes", """
SELECT item_id, name || ' ' || category || ' ' || CAST(size AS VARCHAR) || ' gx - ' || category AS cleaned FROM infoboxes""")
def _(spark, sf):
    return view(spark, sf, "infoboxes").select("item_id", parse.clean_markup("markup").alias("cleaned"))


define("year_texts", "orders", """
SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'c' || CAST(year(o_orderdate) - 40 AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) || '. Built'
       WHEN o_orderstatus = 'O' THEN 'c.' || CAST(year(o_orderdate) AS STRING) || '. Box'
       ELSE CAST(year(o_orderdate) - 190 AS STRING) || 's. Folding' END AS head,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Its run from ' || CAST(year(o_orderdate) - 3 AS STRING) || ' to ' || CAST(year(o_orderdate) AS STRING) || ' was long'
       WHEN o_orderpriority = '1-URGENT' THEN 'Seen 1720 - 1730, then ' || CAST(year(o_orderdate) AS STRING) || '–' || CAST(year(o_orderdate) + 2 AS STRING)
       WHEN o_orderpriority = '2-HIGH' THEN 'Years ' || CAST(year(o_orderdate) AS STRING) || ' – ' || CAST(year(o_orderdate) + 9 AS STRING) || '.'
       WHEN o_orderstatus = 'F' THEN 'It was introduced in ' || CAST(year(o_orderdate) AS STRING) || ' and sold until 2009'
       WHEN o_orderstatus = 'O' THEN 'Sold from ' || CAST(year(o_orderdate) AS STRING) || ' to ' || CAST(year(o_orderdate) + 4 AS STRING)
       ELSE 'The 1987 model, like the ' || CAST(year(o_orderdate) - 60 AS STRING) || ' one' END AS prose
FROM {orders}
""")


@check("parse_year_range", "year_texts", """
SELECT o_orderkey, CAST(regexp_extract(head, '(\\d{4})', 1) AS INT) AS year_from,
       CAST(nullif(regexp_extract(head, '(\\d{4})\\s*[-–]\\s*(\\d{4})', 2), '') AS INT) AS year_to FROM year_texts""")
def _(spark, sf):
    return view(spark, sf, "year_texts").select("o_orderkey", parse.year_range("head").alias("y")).select("o_orderkey", "y.*")


@check("parse_leading_year", "year_texts", """
SELECT o_orderkey, CASE WHEN head LIKE 'c%-%' THEN y - 40 WHEN head LIKE 'c.%' THEN y WHEN y - 190 >= 1820 THEN y - 190 END AS year_from,
       CASE WHEN head LIKE 'c%-%' THEN y END AS year_to FROM year_texts""")
def _(spark, sf):
    return view(spark, sf, "year_texts").select("o_orderkey", parse.leading_year("head").alias("y")).select("o_orderkey", "y.*")


@check("parse_year_in_prose", "year_texts", """
SELECT o_orderkey, CASE WHEN prose LIKE 'The 1987%' THEN least(1987, y - 60) WHEN prose LIKE 'Its run%' THEN y - 3 ELSE y END AS year_from,
       CASE WHEN prose LIKE 'Its run%' THEN y WHEN prose LIKE 'Years%' THEN y + 9 END AS year_to FROM year_texts""")
def _(spark, sf):
    return view(spark, sf, "year_texts").select("o_orderkey", parse.year_in_prose("prose").alias("y")).select("o_orderkey", "y.*")


@check("year_mentions", "", """
SELECT doc_id, list_min(list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_À-ÿ])(1[89]\\d{2}|20[0-2]\\d)(?:$|[^0-9A-Za-z_À-ÿ])', 1), lambda y: CAST(y AS INT))) AS year_from
FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    # No phrase of this prose names a maker or a span, so the fallback over the whole text decides.
    return d.select("doc_id", parse.year_in_prose("text", low=9999, high=9999)["year_from"].alias("year_from"))


define("price_texts", "listings", """
SELECT pos, price AS amount, CAST(round(price) AS BIGINT) AS whole,
  CASE currency WHEN 'USD' THEN '$' || CAST(CAST(round(price) AS BIGINT) AS STRING) || ' to $99999'
       WHEN 'JPY' THEN 'US $1,' || CAST(CAST(round(price) AS BIGINT) % 900 + 100 AS STRING) || '.50' ELSE 'sold' END AS listing,
  CASE currency WHEN 'USD' THEN 'The Average is about $ 1,2' || CAST(CAST(round(price) AS BIGINT) % 10 AS STRING) || '0.25 today'
       WHEN 'JPY' THEN 'price: $' || CAST(CAST(round(price) AS BIGINT) % 7 AS STRING) ELSE 'no amount' END AS labelled
FROM {listings}
""")


@check("parse_price", "price_texts", """
SELECT pos, CASE WHEN listing LIKE '$%' THEN CASE WHEN whole BETWEEN 5 AND 50000 THEN CAST(whole AS DOUBLE) END
                 WHEN listing LIKE 'US%' THEN 1000 + whole % 900 + 100 + 0.5 - 0 END AS price FROM price_texts""")
def _(spark, sf):
    return view(spark, sf, "price_texts").select("pos", parse.price("listing").alias("price"))


@check("parse_labelled_price", "price_texts", """
SELECT pos, CASE WHEN labelled LIKE 'The%' THEN 1200.25 + 10 * (whole % 10) WHEN labelled LIKE 'price%' AND whole % 7 > 0 THEN CAST(whole % 7 AS DOUBLE) END AS price
FROM price_texts""")
def _(spark, sf):
    return view(spark, sf, "price_texts").select("pos", parse.labelled_price("labelled").alias("price"))


@check("first_int", "", """
SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\\d+)', 1), '') AS INT) AS n,
       TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*g', 1), '') AS INT) AS grams FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.first_int("text").alias("n"), parse.first_int("text", "g").alias("grams"))


@check("split_list", "", """
SELECT doc_id, CAST(len(p) AS INT) AS n, md5(array_to_string(p, '|')) AS parts FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)""")
def _(spark, sf):
    p = text.split_list("text")
    return table(spark, sf, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("parts"))


@check("url_titles", "items", """
SELECT item_id, replace(name, ' ', '_') AS title, name || ' & é.jpg' AS file,
       'https://wiki.example.org/wiki/' || replace(name, ' ', '_') AS url FROM items""")
def _(spark, sf):
    i = view(spark, sf, "items")
    link = F.concat(text.title_url("name"), F.lit("#History"))
    file = F.concat(F.lit("https://media.example.org/wiki/File:"), F.replace(F.url_encode(F.concat("name", F.lit(" & é.jpg"))), F.lit("+"), F.lit("%20")))
    return i.select("item_id", text.url_title(link).alias("title"), text.file_name(file).alias("file"), text.title_url("name").alias("url"))


@check("upscale_url", "images", """
SELECT pos, regexp_replace(url, '_[sqtmn]\\.(?:jpg|jpeg|png)$', '_z.jpg') AS url FROM images""")
def _(spark, sf):
    return view(spark, sf, "images").select("pos", text.upscale_url("url").alias("url"))


LEAD = """
WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x) AS p
           FROM (SELECT doc_id, {clean} AS t FROM documents)),
     m AS (SELECT doc_id, p[1] AS a, p[2] AS b, p[3] AS c FROM s),
     j AS (SELECT doc_id, CASE WHEN b IS NOT NULL AND length(a) + length(b) < {cap} THEN a || ' ' || b ELSE a END AS ab,
                  b IS NOT NULL AND length(a) + length(b) < {cap} AS ok, c FROM m)
SELECT doc_id, CASE WHEN length(l) >= {least} THEN regexp_replace(l, '^\\s+|\\s+$', '', 'g') END AS lead FROM (
  SELECT doc_id, CASE WHEN {three} AND ok AND c IS NOT NULL AND length(ab) + length(c) < {cap} THEN ab || ' ' || c ELSE ab END AS l FROM j)"""


@check("lead_sentences_short", "", LEAD.format(
    clean="regexp_replace(regexp_replace(text, '\\s*\\([^)]*Japanese[^)]*\\)', '', 'g'), '\\s*\\([^)]*pronounced[^)]*\\)', '', 'g')",
    cap=250, least=15, three="false"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.lead_sentences("text", **parse.SHORT_LEAD).alias("lead"))


@check("lead_sentences_long", "", LEAD.format(
    clean="regexp_replace(regexp_replace(text, '(?i)\\s*\\([^)]*(?:Japanese|pronounced|listen|stylized|stylised|IPA)[^)]*\\)', '', 'g'), '\\[\\d+\\]', '', 'g')",
    cap=350, least=20, three="true"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.lead_sentences("text", **parse.LONG_LEAD).alias("lead"))


@check("ordered_distinct", "", """
SELECT doc_id, CAST(len(d) AS INT) AS n, md5(array_to_string(d, '|')) AS digest FROM (
  SELECT doc_id, list(w ORDER BY pos) AS d FROM (
    SELECT doc_id, arg_min(w, pos) AS w, min(pos) AS pos FROM (
      SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS p FROM documents))
    GROUP BY doc_id, lower(w)) GROUP BY doc_id)""")
def _(spark, sf):
    words = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"))
    lists = table(spark, sf, "documents").select("doc_id", text.ordered_distinct(words, F.lower).alias("d")).where(F.size("d") > 0)
    return lists.select("doc_id", F.size("d").alias("n"), F.md5(F.array_join("d", "|")).alias("digest"))


@check("tokens", "", """
SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (
  SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)""")
def _(spark, sf):
    t = text.tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))

"""Classifiers, exclusions, scores and generated texts."""

from pyspark.sql import functions as F

from catloom import vocabulary as V
from catloom.checks.base import check, define, table, view
from catloom.functions import rules
from catloom.operators import extract, stats


# Free-text formats and names put together from part attributes.
define("described", "items", """
SELECT item_id, name, brand, category, size, year, year_end, description,
  CASE WHEN size < 4 THEN '35 mm half-frame' WHEN size < 8 THEN 'Type 120 roll' WHEN size < 12 THEN '4 x 5 in' WHEN size < 16 THEN 'Pack film'
       WHEN size < 20 THEN 'medium format, 6 x 7' WHEN size < 24 THEN 'Sheet Film' WHEN size < 28 THEN 'plates' WHEN size < 30 THEN '' END AS raw_format,
  CASE WHEN size < 5 THEN 'SLR' WHEN size < 10 THEN 'View camera' WHEN size < 15 THEN 'Full Frame MILC' WHEN size < 20 THEN 'TLR ' WHEN size < 30 THEN 'camera' WHEN size < 35 THEN 'twin-lens reflex camera' WHEN size < 40 THEN 'Folding' END AS raw_type,
  CASE WHEN size > 40 THEN 'Polaroid' WHEN size > 35 THEN 'Nikon' WHEN size > 30 THEN 'Linhof' ELSE brand END AS maker,
  CASE WHEN size > 25 THEN 'Rolleiflex ' || name WHEN size > 20 THEN name || ' Stereo' WHEN size > 12 THEN name || ' Leica M10' WHEN size > 8 THEN name || ' Digital' WHEN size > 4 THEN 'Canon AE-1 ' || name ELSE name END AS model
FROM {items}
""")


@check("classify_format", "described", """
SELECT item_id, CASE WHEN size < 4 THEN '135' WHEN size < 8 THEN '120' WHEN size < 12 THEN '4x5' WHEN size < 16 THEN 'Instant' WHEN size < 20 THEN '120'
  WHEN size < 24 THEN '4x5' WHEN size < 28 THEN 'plates' END AS fmt FROM described""")
def _(spark, sf):
    return view(spark, sf, "described").select("item_id", rules.normalize_format("raw_format").alias("fmt"))


@check("infer_format", "described", """
SELECT item_id, CASE WHEN raw_type = 'SLR' THEN '135' WHEN raw_type = 'View camera' THEN '4x5' WHEN model LIKE 'Rolleiflex%' THEN '120' WHEN model LIKE '%Stereo' THEN '135'
  WHEN maker = 'Polaroid' THEN 'Instant' WHEN maker = 'Nikon' THEN '135' WHEN maker = 'Linhof' THEN '4x5' END AS fmt FROM described""")
def _(spark, sf):
    return view(spark, sf, "described").select("item_id", rules.infer_format("model", "raw_type", "maker").alias("fmt"))


@check("excluded_tech", "described", """
SELECT item_id, model FROM described WHERE NOT (lower(model) LIKE '%digital%')""")
def _(spark, sf):
    d = view(spark, sf, "described")
    return d.where(~rules.is_excluded_tech("model", "raw_type", "maker")).select("item_id", "model")


@check("non_retail", "", """
SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9_à-ÿ])(?:the|est) [a-z]+ing(?:$|[^a-z0-9_à-ÿ])')
  OR source IN ('src3', 'src7') AS flagged FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    hit = rules.is_non_retail(F.lit(""), F.lower("text"), "source", keywords=(), brands=("src3", "src7"),
                              novelty=(r"(?:^|[^a-z0-9_à-ÿ])(?:the|est) [a-z]+ing(?:$|[^a-z0-9_à-ÿ])",))
    return d.select("doc_id", hit.alias("flagged"))


@check("non_retail_items", "described", """
SELECT item_id, lower(maker) = 'brand#3' OR size > 44 AS flagged FROM described""")
def _(spark, sf):
    d = view(spark, sf, "described")
    text = F.when(F.col("size") > 44, F.lit("Used for aerial reconnaissance.")).otherwise(F.col("description"))
    return d.select("item_id", rules.is_non_retail("model", text, "maker", brands=("brand#3",)).alias("flagged"))


@check("three_way_class", "described", """
SELECT item_id, CASE WHEN lower(model) LIKE '%digital%' THEN 'digital' WHEN model LIKE 'Rolleiflex%' OR model LIKE 'Canon AE-1%' THEN 'analogue' ELSE 'uncertain' END AS class,
       NOT (lower(model) LIKE '%digital%') AS kept, NOT (lower(model) LIKE '%digital%' OR model LIKE 'Rolleiflex%' OR model LIKE 'Canon AE-1%') AS queued FROM described""")
def _(spark, sf):
    d = view(spark, sf, "described")
    label = rules.classify_three_way("model", rules.is_excluded_tech("model"))
    d = d.withColumn("class", label)
    return d.select("item_id", "class", (F.col("class") != "digital").alias("kept"), (F.col("class") == "uncertain").alias("queued"))


@check("display_type", "described", """
SELECT item_id, CASE WHEN size < 5 THEN 'SLR' WHEN size < 10 THEN 'View' WHEN size < 15 THEN 'Mirrorless' WHEN size < 20 THEN 'TLR' WHEN size >= 35 AND size < 40 THEN 'Folding' END AS shown,
  CASE WHEN size < 5 THEN 'SLR' WHEN size < 10 THEN 'View camera' WHEN size < 15 THEN 'Full Frame MILC' WHEN size < 20 THEN 'TLR' WHEN size < 30 THEN 'camera' WHEN size < 35 THEN 'TLR' WHEN size < 40 THEN 'Folding' END AS typed,
  CASE WHEN size < 20 THEN 'SLR' WHEN size > 40 THEN 'TLR' END AS chinese FROM described""")
def _(spark, sf):
    cn = F.when(F.col("size") < 20, F.concat("brand", F.lit("135单反相机"))).when(F.col("size") > 40, F.lit("双反")).otherwise(F.col("name"))
    return view(spark, sf, "described").select(
        "item_id", rules.display_type("raw_type").alias("shown"), rules.type_from_markup("raw_type").alias("typed"),
        rules.classify_fragment(cn, V.CHINESE_TYPE_FRAGMENTS).alias("chinese"))


@check("category_labels", "described", """
SELECT item_id, NOT (size < 10) OR category = 'SMALL' AS is_item,
  CASE WHEN size >= 30 THEN 'Folding' WHEN size >= 20 THEN 'Medium format' WHEN size >= 10 THEN 'SLR' END AS item_type,
  CASE WHEN size >= 30 THEN '126' WHEN size >= 20 THEN '120' END AS fmt FROM described""")
def _(spark, sf):
    cats = (
        F.when(F.col("size") >= 30, F.array(F.lit("Category:126 cameras"), F.lit("Category:Folding cameras"), F.lit("Category:SLR cameras")))
        .when(F.col("size") >= 20, F.array(F.lit("Category:Medium format cameras"), F.lit("35mm")))
        .when(F.col("size") >= 10, F.array(F.lit("Things"), F.lit("Category:SLR cameras")))
        .otherwise(F.array(F.when(F.col("category") == "SMALL", F.lit("Camera shops")).otherwise(F.col("category")))))
    d = view(spark, sf, "described").withColumn("cats", cats)
    return d.select(
        "item_id", rules.is_item_page("cats").alias("is_item"),
        rules.label_from_categories("cats", V.CATEGORY_TYPES).alias("item_type"),
        rules.label_from_categories("cats", V.CATEGORY_FORMATS).alias("fmt"))


@check("flag_suspects", "described", """
SELECT item_id, CASE WHEN lower(model) LIKE '%digital%' THEN '\\bdigital\\b' WHEN size BETWEEN 13 AND 14 THEN '\\bmirrorless\\b' END AS pattern FROM described
WHERE lower(model) LIKE '%digital%' OR size BETWEEN 13 AND 14""")
def _(spark, sf):
    d = view(spark, sf, "described")
    text = F.when(F.col("size").between(13, 14), F.concat_ws(" ", "model", F.lit("Mirrorless"))).otherwise(F.col("model"))
    return d.select("item_id", rules.first_matching_pattern(text, V.SUSPECT_PATTERNS).alias("pattern")).where("pattern is not null")


@check("boilerplate_text", "", f"""
SELECT doc_id, regexp_matches(text, '(?i){"|".join(V.BOILERPLATE_PATTERNS)}') AS hit FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.is_boilerplate("text").alias("hit"))


@check("triage", "images", """
SELECT pos, CASE WHEN fraction > 0.07 OR bytes < 20000 THEN 'drop' WHEN fraction < 0.04 AND width > 20 THEN 'auto' ELSE 'review' END AS decision FROM images""")
def _(spark, sf):
    decision = rules.triage("fraction", "bytes", "width", drop_above=0.07, auto_below=0.04, min_width=20)
    return view(spark, sf, "images").select("pos", decision.alias("decision"))


@check("exclude_bundles", "described", """
SELECT item_id, size > 20 AND size <= 25 AS bundle FROM described""")
def _(spark, sf):
    d = view(spark, sf, "described")
    name = F.when(F.col("size").between(21, 25), F.concat("name", F.lit(" Gift  Bundle"))).otherwise(F.concat("name", F.lit(" bundles")))
    return d.select("item_id", rules.is_bundle(name).alias("bundle"))


@check("exclude_accessory_images", "images", """
SELECT pos, url FROM images WHERE source <> 'shop' AND NOT (source = 'archive' AND width > 25)""")
def _(spark, sf):
    i = view(spark, sf, "images")
    path = F.when(F.col("source") == "shop", F.concat("url", F.lit("/Lens-Cap.jpg"))).when(
        (F.col("source") == "archive") & (F.col("width") > 25), F.concat("url", F.lit("/2019-05-01_shot.jpg"))).otherwise(F.col("url"))
    return i.where(rules.shows_item(path)).select("pos", "url")


@check("title_relevant", "listings", """
SELECT pos, o >= greatest(2.0, 0.5 * n) AS relevant FROM (
  SELECT pos, len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), q)) AS o, len(q) AS n
  FROM (SELECT pos, replace(title, 'red', 'blue') AS title, list_distinct(regexp_extract_all(lower(query || ' deluxe mark'), '[a-z0-9]+')) AS q FROM listings))""")
def _(spark, sf):
    return view(spark, sf, "listings").select(
        "pos", rules.title_relevant(F.replace("title", F.lit("red"), F.lit("blue")), F.concat("query", F.lit(" deluxe mark"))).alias("relevant"))


@check("title_matches", "listings", """
WITH t AS (SELECT pos, CASE WHEN currency = 'JPY' AND year > 2000 THEN 'foreign' WHEN currency = 'EUR' THEN 'sunset at the sea' WHEN currency = 'USD' AND year % 2 = 0 THEN lower(split_part(title, ' ', 2)) || ' only'
    WHEN currency = 'USD' THEN lower(substr(title, length(brand) + 2)) ELSE 'own' END AS shown,
  list_filter(string_split(trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1) AS q FROM listings)
SELECT pos, shown = 'own' OR (shown NOT IN ('foreign', 'sunset at the sea') AND len(list_filter(q, lambda w: contains(shown, w))) >= 0.5 * len(q)) AS matches FROM t""")
def _(spark, sf):
    shown = (
        F.when((F.col("currency") == "JPY") & (F.col("year") > 2000), F.concat("title", F.lit(" vs Nikon")))
        .when(F.col("currency") == "EUR", F.lit("Sunset at the sea"))
        # Without the brand the share of the name's words decides.
        .when((F.col("currency") == "USD") & (F.col("year") % 2 == 0), F.concat(F.split_part("title", F.lit(" "), F.lit(2)), F.lit(" only")))
        .when(F.col("currency") == "USD", F.substr("title", F.length("brand") + 2))
        .otherwise(F.upper("title")))
    return view(spark, sf, "listings").select("pos", rules.title_matches(shown, "query", "brand").alias("matches"))


@check("score_url", "", """
SELECT page_id, CASE WHEN contains(regexp_replace(lower(url), '-|_|%20', '', 'g'), 'th') THEN 0 ELSE -50 END
  + CASE WHEN contains(lower(url), 'logo') THEN 20 ELSE 0 END + CASE WHEN contains(lower(url), 'brand') THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(url), 'transparent') THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(lower(url), '\\.svg$') THEN 25 WHEN regexp_matches(lower(url), '\\.png$') THEN 15 WHEN regexp_matches(lower(url), '\\.webp$') THEN 5 WHEN regexp_matches(lower(url), '\\.jpe?g$') THEN -5 ELSE 0 END
  + CASE WHEN regexp_matches(lower(url), 'photo|camera-|store|shop|product') THEN -20 ELSE 0 END
  + CASE WHEN regexp_matches(regexp_replace(lower(url), '-|_', '', 'g'), 'bubbletea|railway|crrc|realestate|tang|collection|eyewear|glasses|opticalframe') THEN -40 ELSE 0 END
  + CASE WHEN regexp_matches(lower(url), 'thumb|small') THEN -10 ELSE 0 END AS score FROM (SELECT page_id, url || CASE WHEN contains(url, '.html') THEN '/black-white/logo.svg' ELSE '' END AS url, url AS u FROM pages)""".replace("AS score", "+ CASE WHEN contains(url, 'black-white') THEN 5 ELSE 0 END AS score"))
def _(spark, sf):
    url = F.concat("url", F.when(F.contains("url", F.lit(".html")), F.lit("/black-white/logo.svg")).otherwise(F.lit("")))
    return table(spark, sf, "pages").select("page_id", rules.score_url(url, F.lit("T H")).alias("score"))


@check("top_urls_by_score", "images", """
SELECT supplier_id, url, score FROM (
  SELECT supplier_id, url, width % 7 * 5 AS score, row_number() OVER (PARTITION BY supplier_id ORDER BY width % 7 DESC, item_id, pos) AS rn FROM images) WHERE rn <= 5""")
def _(spark, sf):
    from catloom.operators.rank import top_per_group
    i = view(spark, sf, "images").withColumn("score", F.col("width") % 7 * 5)
    return top_per_group(i, ["supplier_id"], [F.desc("score"), F.col("item_id"), F.col("pos")], 5).select("supplier_id", "url", "score")


@check("pick_best_image", "images", """
SELECT item_id, arg_max(url, (s, -pos)) AS url, max(s) AS score FROM (
  SELECT item_id, pos, url, CASE WHEN source = 'archive' THEN 10 ELSE 0 END + CASE WHEN bytes / 10 > 300 AND bytes / 10 < 4000 THEN 5 ELSE 0 END + CASE WHEN width > 30 THEN 20 ELSE 0 END AS s
  FROM images WHERE NOT (source = 'shop' AND width < 20) AND NOT (source = 'archive' AND width = 41) AND bytes / 10 >= 1000 AND width * 4 >= 30) GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "images")
    title = F.when((F.col("source") == "shop") & (F.col("width") < 20), F.lit("Map.png")).when(F.col("width") > 30, F.lit("The_Thing_1.jpg")).otherwise(F.lit("x.jpg"))
    mime = F.when(F.col("source") == "archive", F.lit("image/jpeg")).otherwise(F.lit("image/png"))
    score = rules.photo_score(title, mime, F.col("bytes") / 10, F.lit("The Thing"))
    url = F.when((F.col("source") == "archive") & (F.col("width") == 41), F.lit("")).otherwise(F.col("url"))
    usable = rules.usable_photo(title, url, F.col("bytes") / 10, F.col("width") * 40, 1000, 300)
    return extract.pick_best_candidate(i, "item_id", score, "url", "pos", usable)


@check("pick_best_logo", "images", """
SELECT item_id, arg_max(url, (s, -pos)) AS url, max(s) AS score FROM (
  SELECT item_id, pos, url, CASE WHEN source = 'archive' THEN 15 WHEN source = 'shop' AND width > 25 THEN -10 WHEN width < 5 THEN -20 ELSE 0 END AS s FROM images) WHERE s >= 0 GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "images")
    title = F.when(F.col("source") == "archive", F.lit("Brand Logo.svg")).when((F.col("source") == "shop") & (F.col("width") > 25), F.lit("Building.png")).otherwise(F.lit("x.png"))
    mime = F.when((F.col("source") != "archive") & ~((F.col("source") == "shop") & (F.col("width") > 25)) & (F.col("width") < 5), F.lit("application/pdf")).otherwise(F.lit("image/png"))
    return extract.pick_best_candidate(i, "item_id", rules.logo_score(title, mime), "url", "pos", min_score=0)


@check("prestige_brand", "described", """
SELECT item_id, maker IN ('Polaroid', 'Nikon', 'Linhof') OR brand = 'Brand#7' AS prestige FROM described""")
def _(spark, sf):
    brand = F.when(F.col("brand") == "Brand#7", F.lit("VEB Zeiss Jena")).otherwise(F.col("maker"))
    return view(spark, sf, "described").select("item_id", rules.is_prestige(brand).alias("prestige"))


@check("useless_description", "items", """
SELECT item_id, description IS NULL OR length(trim(description)) < 5 AS useless,
  description IS NULL OR description LIKE '%It shoots%film.%' AS template FROM items""")
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", rules.is_useless_description("description").alias("useless"), rules.is_template_description("description").alias("template"))


@check("facet_filter", "items", """
SELECT item_id, name, year FROM items WHERE country IN ('NATION_3') AND fmt IN ('135', '120') AND lower(brand) = 'brand#3'
  AND floor(year / 10) * 10 IN (1950, 1960, 1970) AND contains(lower(name), 'e')""")
def _(spark, sf):
    return stats.facet_filter(view(spark, sf, "items"), "NATION_3", ["135", "120"], "BRAND#3", [1950, 1960, 1970], "E").select("item_id", "name", "year")


@check("brand_filter", "items", """
SELECT brand, region, count(*) AS n FROM items WHERE region = 'ASIA' AND contains(lower(brand), '1') GROUP BY ALL""")
def _(spark, sf):
    brands = view(spark, sf, "items").groupBy("brand", "region").agg(F.count("*").alias("n"))
    named = brands.withColumnRenamed("brand", "name")
    return stats.brand_filter(named, "ASIA", "1").withColumnRenamed("name", "brand")


define("claims", "items", """
SELECT item_id, size, '{{"P31":[{{"mainsnak":{{"datavalue":{{"type":"wikibase-entityid","value":{{"id":"Q' || CAST(size AS STRING) || '"}}}}}}}}],"P571":[{{"mainsnak":{{"datavalue":{{"type":"time","value":{{"time":"+' || CAST(1950 + size AS STRING) || '-01-01T00:00:00Z"}}}}}}}}],"P18":[{{"mainsnak":{{"datavalue":{{"type":"string","value":"' || name || '"}}}}}}]'
  || CASE WHEN size > 10 THEN ',"P2067":[{{"mainsnak":{{"datavalue":{{"type":"quantity","value":{{"amount":"+' || CAST(size * 10 AS STRING) || '"}}}}}}}}]' ELSE '' END || '}}' AS claims, name
FROM {items}
""")


@check("has_all_claims", "claims", "SELECT item_id, size IN (5, 20, 40) AND size > 10 AS kept FROM claims")
def _(spark, sf):
    return view(spark, sf, "claims").select("item_id", extract.has_all_claims("claims", "P31", ["Q5", "Q20", "Q40"], "P2067").alias("kept"))


@check("claim_values", "claims", """
SELECT item_id, 'Q' || CAST(size AS VARCHAR) AS kind, CAST(1950 + size AS VARCHAR) AS year, name AS file, CASE WHEN size > 10 THEN CAST(size * 10 AS VARCHAR) END AS weight FROM claims""")
def _(spark, sf):
    v = lambda p: extract.claim_value("claims", p)
    return view(spark, sf, "claims").select("item_id", v("P31").alias("kind"), v("P571").alias("year"), v("P18").alias("file"), v("P2067").alias("weight"))


@check("prose_format_and_brand", "described", """
SELECT item_id, CASE WHEN size < 20 THEN '35mm' WHEN size > 40 THEN 'Instant' END AS fmt,
  CASE WHEN size < 20 THEN 'Maker ' || CAST(size AS VARCHAR) ELSE split_part(model, ' ', 1) END AS brand FROM described""")
def _(spark, sf):
    size = F.col("size").cast("string")
    article = (
        F.when(F.col("size") < 20, F.concat(F.lit("{{Box}}\nThe "), "name", F.lit(" takes 35 mm film.\nIt was made by [[Maker "), size, F.lit("|x]].\n== See also ==\n120 film")))
        .when(F.col("size") > 40, F.concat(F.lit("|x\nUses instant film, built by the "), size, F.lit(" people"))).otherwise(F.concat("name", F.lit("\n== Film ==\n120 film"))))
    return view(spark, sf, "described").select("item_id", rules.format_from_prose(article).alias("fmt"), rules.brand_from_prose(article, "model").alias("brand"))


@check("placeholder_images", "images", """
SELECT item_id, count(*) AS kept FROM images WHERE local_path IS NOT NULL OR source = 'archive' GROUP BY item_id""")
def _(spark, sf):
    i = view(spark, sf, "images")
    url = F.when(F.col("source") == "archive", F.concat(F.lit("https://upload.wikimedia.org/"), "item_id")).otherwise(F.col("url"))
    one = i.select("item_id", F.array(F.struct(url.alias("url"), "local_path")).alias("images"))
    return one.select("item_id", F.size(rules.real_images("images")).alias("n")).groupBy("item_id").agg(F.sum("n").alias("kept")).where("kept > 0")


@check("drop_icon_images", "images", "SELECT pos, url FROM images WHERE source <> 'shop'")
def _(spark, sf):
    i = view(spark, sf, "images")
    url = F.when(F.col("source") == "shop", F.lit("https://x.example.org/icons/a.png")).otherwise(F.col("url"))
    one = i.select("pos", rules.drop_placeholders(F.array(F.struct(url.alias("url")))).alias("kept"))
    return one.select("pos", F.explode("kept.url").alias("url"))


@check("template_description", "described", """
SELECT item_id, CASE WHEN m IS NOT NULL AND year IS NOT NULL AND f IS NOT NULL THEN 'The ' || name || ' is a ' || t || ' produced by ' || m || ' in ' || CAST(year AS VARCHAR) || '. It shoots ' || f || ' film.'
  WHEN m IS NOT NULL AND year IS NOT NULL THEN 'The ' || name || ' is a ' || t || ' produced by ' || m || ' in ' || CAST(year AS VARCHAR) || '.'
  WHEN m IS NOT NULL AND f IS NOT NULL THEN 'The ' || name || ' is a ' || t || ' by ' || m || '. ' || f || ' format.'
  WHEN m IS NOT NULL THEN 'A ' || t || ' by ' || m || '.' ELSE 'An analogue ' || t || '.' END AS text
FROM (SELECT item_id, name, year, nullif(raw_format, '') AS f, CASE WHEN category <> 'PROMO' THEN maker END AS m, coalesce(CASE WHEN raw_type <> 'camera' THEN raw_type END, 'camera') AS t FROM described)""")
def _(spark, sf):
    maker = F.when(F.col("category") != "PROMO", F.col("maker"))
    return view(spark, sf, "described").select("item_id", rules.template_description("name", maker, "raw_type", "year", "raw_format").alias("text"))


@check("rich_description", "described", """
SELECT item_id, CASE WHEN year IS NOT NULL AND year_end IS NOT NULL THEN 'The ' || name || ' is a ' || k || ' produced by ' || maker || ' from ' || CAST(year AS VARCHAR) || ' to ' || CAST(year_end AS VARCHAR) || '.'
  WHEN year IS NOT NULL THEN 'The ' || name || ' is a ' || k || ' introduced by ' || maker || ' in ' || CAST(year AS VARCHAR) || '.' ELSE 'The ' || name || ' is a ' || k || ' made by ' || maker || '.' END
  || CASE WHEN size > 10 THEN ' It features M42 lens mount, ' || lower(category) || ' metering.' ELSE '' END
  || CASE WHEN size * 40 >= 1000 THEN ' It weighs ' || printf('%.1f', size * 40 / 1000.0) || ' kg.' ELSE ' It weighs ' || CAST(size * 40 AS VARCHAR) || ' g.' END AS text
FROM (SELECT *, CASE WHEN size < 17 THEN '35mm ' WHEN size < 34 THEN 'medium format (120) ' WHEN size < 40 THEN '4×5 large format ' ELSE '' END ||
  CASE WHEN size < 5 THEN 'SLR camera' WHEN size < 10 THEN 'View camera' WHEN size < 15 THEN 'Full Frame MILC' WHEN size < 20 THEN 'TLR ' WHEN size < 30 THEN 'medium format camera' WHEN size < 35 THEN 'twin-lens reflex (TLR) camera' WHEN size < 40 THEN 'folding camera' ELSE 'camera' END AS k FROM described)""")
def _(spark, sf):
    size = F.col("size")
    fmt = F.when(size < 17, F.lit("135")).when(size < 34, F.lit("120")).when(size < 40, F.lit("4x5"))
    lens, meter = F.when(size > 10, F.lit("M42")), F.when(size > 10, F.lower("category"))
    text = rules.rich_description("name", "maker", "raw_type", "year", "year_end", fmt, lens, F.lit(None).cast("string"), meter, size * 40)
    return view(spark, sf, "described").select("item_id", text.alias("text"))


@check("decade_labels", "items", """
SELECT item_id, CAST(floor(year / 10) * 10 AS INT) AS decade, coalesce(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's', 'Unknown year') AS label,
  CASE WHEN year IS NULL THEN NULL WHEN year_end IS NULL THEN CAST(year AS VARCHAR) ELSE CAST(year AS VARCHAR) || '–' || CAST(year_end AS VARCHAR) || CASE WHEN year_end > year THEN ' (' || CAST(year_end - year AS VARCHAR) || ' years)' ELSE '' END END AS span FROM items""")
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", rules.decade("year").alias("decade"), rules.decade_label("year").alias("label"), rules.year_span_text("year", "year_end").alias("span"))


@check("spec_map", "described", """
SELECT item_id, array_to_string(list_filter([
  CASE WHEN size < 5 THEN 'type=SLR' WHEN size < 10 THEN 'type=View' WHEN size < 15 THEN 'type=Mirrorless' WHEN size < 20 THEN 'type=TLR' WHEN size >= 35 AND size < 40 THEN 'type=Folding' END,
  'format=' || nullif(raw_format, ''), 'weight=' || CAST(size * 40 AS VARCHAR) || 'g', 'battery=' || category], lambda x: x IS NOT NULL), ';') AS specs FROM described""")
def _(spark, sf):
    none = F.lit(None).cast("string")
    specs = rules.spec_map("raw_type", "raw_format", none, F.lit(""), none, F.col("size") * 40, none, "category")
    text = F.array_join(F.transform(F.map_entries(specs), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return view(spark, sf, "described").select("item_id", text.alias("specs"))

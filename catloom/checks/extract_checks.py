"""Extraction from pages, API answers and model answers; streams and file listings."""

from pyspark.sql import functions as F

from catloom.checks.base import check, define, table, view
from catloom.functions.values import compute_once
from catloom.operators import extract
from catloom.runtime import spread, work_folder
from catloom.sources import files
from catloom.streaming import resume, toggles

# One wiki article per item, with a nested template in its box and a table of the same brand.
define("articles", "items", """
SELECT item_id, name, brand, category, size, year, fmt, brand || ' ' || name AS title,
  'Intro text' || chr(10) || '{{{{Infobox camera' || chr(10) || '| name = ' || name || chr(10)
  || CASE WHEN size > 10 THEN '| maker = [[' || brand || ']]' || chr(10) ELSE '' END
  || '| produced = ' || coalesce(CAST(year AS STRING) || '–' || CAST(year + 5 AS STRING), '') || chr(10)
  || '| type = {{{{nowrap|' || lower(category) || '}}}} SLR' || chr(10) || '| Weight = {{{{convert|' || CAST(size * 40 AS STRING) || '|g|oz}}}}' || chr(10)
  || '| film_size = ' || coalesce(fmt, '') || chr(10) || '}}}}' || chr(10) || 'The end. {{{{x}}}}' AS wikitext
FROM {items}
""")


def _params(spark, sf):
    return compute_once(spread(view(spark, sf, "articles")), params=extract.kv_block("wikitext", ["Infobox camera", "Infobox camera model"]))


@check("kv_block", "articles", """
SELECT item_id, 'film_size=' || coalesce(fmt, '') || CASE WHEN size > 10 THEN ';maker=[[' || brand || ']]' ELSE '' END || ';name=' || name || ';produced=' || coalesce(CAST(year AS VARCHAR) || '–' || CAST(year + 5 AS VARCHAR), '')
  || ';type={{nowrap|' || lower(category) || '}} SLR;weight={{convert|' || CAST(size * 40 AS VARCHAR) || '|g|oz' AS params FROM articles""")
def _(spark, sf):
    entries = F.array_sort(F.map_entries("params"))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _params(spark, sf).select("item_id", text.alias("params"))


@check("item_from_params", "articles", """
SELECT item_id, name, split_part(brand, ' ', 1) AS brand, year AS year_from, year + 5 AS year_to, fmt, 'SLR' AS item_type, CAST(NULL AS INT) AS weight_g FROM articles""")
def _(spark, sf):
    p = extract.item_from_params(_params(spark, sf).select("item_id", "title", "params"), "title", "params")
    return p.select("item_id", "name", "brand", "year_from", "year_to", "fmt", "item_type", "weight_g")


define("film_pages", "items", """
SELECT item_id, name, brand, size, '{{{{Infobox film stock|name=' || name || chr(10) || '| iso = ISO ' || CAST(size * 10 AS STRING) || '/21' || chr(10) || '| formats = 135; 120,, ' || lower(category) || chr(10) || '| grain = <b>fine</b>' || chr(10) || '}}}}' AS wikitext, category FROM {items}
""")


@check("film_from_params", "film_pages", """
SELECT item_id, name, brand, size * 10 AS iso_speed, 'fine' AS grain, '135|120|' || lower(category) AS formats FROM film_pages""")
def _(spark, sf):
    p = view(spark, sf, "film_pages").select("item_id", F.concat_ws(" ", "brand", "name").alias("title"), extract.kv_block("wikitext", ["Infobox film stock"]).alias("params"))
    return extract.film_from_params(p, "title", "params").select("item_id", "name", "brand", "iso_speed", "grain", F.array_join("available_formats", "|").alias("formats"))


def _list_pages(spark, sf):
    """One list page per order: a section, a table with a header and one row per line item."""
    l = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    ids = F.concat(s("l_partkey"), F.lit("-"), s("l_linenumber"), F.lit("-"), s("l_suppkey"))
    row = F.concat(F.lit("|-\n| [[Film "), ids, F.lit("|F "), ids, F.lit("]]\n| align=right | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" || "), F.col("l_returnflag"))
    pages = spread(l.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows")))
    head = F.concat(F.lit("== [[Maker "), (F.col("page_id") % 7).cast("string"), F.lit("|M]] ==\n{| class=\"wikitable\"\n! Film !! style=\"x\" | ISO !! Note\n"))
    return pages.select("page_id", F.concat(head, "rows", F.lit("\n|}\ntext")).alias("wikitext"))


ROW = "'|-' || chr(10) || '| [[Film ' || ids || '|F ' || ids || ']]' || chr(10) || '| align=right | ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' || ' || l_returnflag"
LISTED = f"""
WITH l AS (SELECT *, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS ids FROM lineitem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW}) AS INT) AS row_no FROM l)
"""


@check("explode_tables", "", f"""{LISTED}
SELECT l_orderkey AS page_id, 1 AS table_no, row_no, 'Maker ' || CAST(l_orderkey % 7 AS VARCHAR) AS section, 'F ' || ids AS film,
  CAST(CAST(l_quantity AS INT) AS VARCHAR) AS iso, l_returnflag AS note FROM r""")
def _(spark, sf):
    r = extract.explode_tables(_list_pages(spark, sf), "page_id", "wikitext")
    return r.select("page_id", "table_no", "row_no", "section", F.col("cells")["Film"].alias("film"), F.col("cells")["ISO"].alias("iso"), F.col("cells")["Note"].alias("note"))


@check("films_from_tables", "", f"""{LISTED}
SELECT l_orderkey AS page_id, row_no, 'F ' || ids AS name, 'Maker ' || CAST(l_orderkey % 7 AS VARCHAR) AS brand, CAST(l_quantity AS INT) AS iso_speed FROM r""")
def _(spark, sf):
    r = extract.explode_tables(_list_pages(spark, sf), "page_id", "wikitext")
    return extract.films_from_tables(r).select("page_id", "row_no", "name", "brand", "iso_speed")


@check("html_table_rows", "", """
SELECT CAST(o_custkey AS VARCHAR) AS page_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_no, 'Item ' || CAST(o_orderkey AS VARCHAR) AS name, '/i/' || CAST(o_orderkey AS VARCHAR) AS href, CAST(year(o_orderdate) AS VARCHAR) AS year_text, o_orderpriority AS type FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    row = F.concat(F.lit("<tr><td>"), F.year("o_orderdate").cast("string"), F.lit("</td><td><a href='/i/"), key, F.lit("'>Item "), key, F.lit("</a></td><td> "), "o_orderpriority", F.lit("</td></tr>"))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row"))))
    pages = o.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit("<p>x</p><table><tr><th>Produced</th><th>Model</th><th>Kind</th></tr>"), "rows", F.lit("</table>"))
    return extract.html_table_rows(pages.select("o_custkey", html.alias("html")), "o_custkey", "html").select("page_key", "row_no", "name", "href", "year_text", "type")


@check("extract_links", "", """
SELECT page_id, url, CAST(min(pos) - 1 AS INT) AS pos FROM (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS l FROM pages)) GROUP BY page_id, url""")
def _(spark, sf):
    return extract.extract_links(table(spark, sf, "pages"), "page_id", "html", '<a href="([^"]+)"')


@check("visible_text", "", """
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(extract.visible_text("html")).alias("digest"))


@check("intro_images", "", """
SELECT page_id, CAST(len(d) AS INT) AS n, md5(array_to_string(d, ' ')) AS digest FROM (
  SELECT page_id, coalesce(list(u ORDER BY pos) FILTER (u IS NOT NULL), []) AS d FROM (
    SELECT page_id, arg_min(u, pos) AS u, min(pos) AS pos FROM (
      SELECT p.page_id, x.u, x.pos FROM pages p LEFT JOIN (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(split_part(html, '<article>', 1), '<a href="([^"]+)"', 1) AS l FROM pages)) x
      ON x.page_id = p.page_id AND NOT regexp_matches(x.u, '(?i)logo|icon')) GROUP BY page_id, u) GROUP BY page_id)""")
def _(spark, sf):
    images = extract.intro_images("html", '<a href="([^"]+)"', stop="<article>")
    return table(spark, sf, "pages").select("page_id", images.alias("d")).select("page_id", F.size("d").alias("n"), F.md5(F.array_join("d", " ")).alias("digest"))


@check("labelled_fields", "", """
WITH r AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '>([^<>]+)<', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)),
m AS (SELECT *, max(CASE WHEN t IN ('the', 'The', 'la', 'La', 'de', 'De', 'and', 'to') THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS anchor FROM r),
v AS (SELECT m.page_id, h.t AS label, m.anchor, nullif(trim(string_agg(m.t, ' ' ORDER BY m.pos)), '--') AS value FROM m JOIN r h ON h.page_id = m.page_id AND h.pos = m.anchor WHERE m.t NOT IN ('the', 'The', 'la', 'La', 'de', 'De', 'and', 'to') GROUP BY ALL)
SELECT page_id, label, md5(arg_max(value, anchor)) AS digest FROM v GROUP BY page_id, label""")
def _(spark, sf):
    runs = F.filter(F.transform(F.regexp_extract_all("html", F.lit(">([^<>]+)<")), lambda x: F.trim(x)), lambda x: x != "")
    p = table(spark, sf, "pages").select("page_id", runs.alias("texts"))
    fields = extract.labelled_fields(p, "page_id", "texts", ["the", "The", "la", "La", "de", "De", "and", "to"])
    return fields.select("page_id", "label", F.md5("value").alias("digest"))


@check("listing_cards", "listings", """
SELECT item_id, title, price, currency FROM listings""")
def _(spark, sf):
    l = view(spark, sf, "listings")
    card = F.struct("title", F.struct(F.col("price").cast("string").alias("value"), "currency").alias("price"))
    pages = l.select("item_id", F.to_json(F.struct(F.array(card).alias("itemSummaries"))).alias("answer"))
    return extract.listing_cards(pages, "item_id", "answer").select("item_id", "title", "price", "currency")


@check("html_cards", "listings", """
SELECT item_id, pos AS listing, title, CASE WHEN currency = 'USD' AND round(price) BETWEEN 5 AND 50000 THEN CAST(round(price) AS DOUBLE) END AS price FROM listings""")
def _(spark, sf):
    l = spread(view(spark, sf, "listings").select("item_id", "pos", "title", "price", "currency"))
    style = F.when(F.col("currency") == "USD", F.lit("s-card__price bold")).when(F.col("currency") == "JPY", F.lit("bold strikethrough s-card__price")).otherwise(F.lit("s-card__price"))
    # Crossed and stray tags, hidden and secondary texts, an open item in front, and a card outside the results.
    html = F.concat(
        F.lit('<li class="s-card"><div class="s-card__title"><span class="su-styled-text primary">ad</span></div></li>'
              '<div id="srp-river-results"><ul><li class="head">Results <li class="x s-card"></b><div class="s-card__title"><i><b></i>'
              '<span class="su-styled-text primary default"><script>var x;</script>'), "title",
        F.lit('</span></b><span class="clipped">Opens in a new window</span></div></p><span class="'), style, F.lit('">$'),
        F.round("price").cast("bigint").cast("string"), F.lit('</span><span class="s-card__price bold">$9</span></li></ul></div>'))
    pages = l.select("item_id", F.struct("item_id", F.col("pos").alias("listing")).alias("key"), html.alias("html"))
    return extract.html_cards(pages, "key", "html").select("key.item_id", "key.listing", "title", "price")


@check("nested_media", "images", """
SELECT item_id, pos, CASE source WHEN 'archive' THEN 'https:' || substr(url, 7) ELSE url END AS url FROM images WHERE source <> 'shop'""")
def _(spark, sf):
    i = view(spark, sf, "images")
    none = F.lit(None).cast("string")
    content = F.when(F.col("source") == "archive", F.substr("url", F.lit(7)))
    media = F.array(
        F.struct(F.lit("Sound").alias("type"), F.lit("s").alias("content"), none.alias("thumbnail")),
        F.struct(F.when(F.col("source") == "shop", F.lit("3D")).otherwise(F.lit("Images")).alias("type"), content.alias("content"), F.col("url").alias("thumbnail")))
    rows = i.select(F.struct("item_id", "pos").alias("key"), F.to_json(media).alias("answer"))
    return extract.nested_media(rows, "key", "answer").select("key.item_id", "key.pos", "url")


define("answers", "events", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM {events}
""")


def _answers(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@check("parse_price_answers", "listings answers cpi fx", """
WITH v AS (SELECT event_id, CAST(k * 10 AS DOUBLE) AS price, CASE event_type WHEN 'view' THEN 'USD' WHEN 'click' THEN 'JPY' ELSE 'EUR' END AS currency, 1950 + k AS year FROM answers WHERE event_type IN ('view', 'click', 'purchase') AND k > 0 AND 1950 + k <= 2025),
q AS (SELECT DISTINCT currency, year FROM v), n AS (SELECT q.currency, q.year, arg_min(fx.rate, (abs(fx.year - q.year), fx.year)) AS rate FROM q JOIN fx ON fx.currency = q.currency GROUP BY ALL),
u AS (SELECT v.*, CASE WHEN v.currency = 'USD' THEN v.price ELSE CAST(round(CAST(CAST(v.price / n.rate AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) END AS usd FROM v LEFT JOIN n ON n.currency = v.currency AND n.year = v.year)
SELECT event_id, price, currency, year, usd FROM u WHERE usd <= 900""")
def _(spark, sf):
    k = F.col("k").cast("string")
    code = F.when(F.col("event_type") == "click", F.lit('"currency": "jpy", ')).when(F.col("event_type") == "purchase", F.lit('"currency": "EUR", ')).otherwise(F.lit(""))
    year = (F.col("k") + 1950).cast("string")
    good = F.concat(F.lit('Sure: {"price": '), k, F.lit("0, "), code, F.lit('"year": '), year, F.lit("} ok"))
    text = F.when(F.col("event_type") == "error", F.lit("Unknown {\"price\": 5, \"year\": 1990}")).when(F.col("event_type") == "signup", F.concat(F.lit('{"price": "'), k, F.lit('", "year": 1990}'))).otherwise(good)
    return extract.parse_price_answers(_answers(spark, sf).withColumn("text", text), "event_id", "text", view(spark, sf, "fx"), cap=900)


@check("parse_label_answers", "answers", """
SELECT 'e' || CAST(k AS VARCHAR) AS id, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'SLR' ELSE 'Point & Shoot' END AS label FROM answers WHERE event_type IN ('view', 'click') GROUP BY 1""")
def _(spark, sf):
    a = _answers(spark, sf)
    kind = F.when(F.col("event_type") == "view", F.lit(" slr")).when(F.col("event_type") == "click", F.lit("point & SHOOT")).otherwise(F.lit("Robot"))
    text = F.concat(F.lit('Here:\n[{"id": "e'), F.col("k").cast("string"), F.lit('", "type": "'), kind, F.lit('"},\n {"id": "", "type": "SLR"}] done'))
    return extract.parse_label_answers(a.withColumn("text", text), "event_id", "text")


@check("parse_text_and_ratings", "answers", """
SELECT event_id, 'Text ' || CAST(k AS VARCHAR) || '.' || CASE WHEN event_type = 'error' THEN chr(10) || '{"buildQuality": ' || printf('%.1f', k / 10.0) || ', "value": 9, "collectibility": 3}' ELSE '' END AS text, CASE WHEN event_type IN ('view', 'click') THEN greatest(1.0, least(5.0, k / 10.0)) END AS build, CASE WHEN event_type IN ('view', 'click') THEN CAST(5 AS DOUBLE) END AS worth FROM answers""")
def _(spark, sf):
    k = F.col("k").cast("string")
    scores = F.concat(F.lit('{"buildQuality": '), F.format_string("%.1f", F.col("k") / 10.0), F.lit(', "value": 9, "collectibility": 3'), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.lit(', "historicalSignificance": 2')), F.lit("}"))
    body = F.concat(F.lit("Text "), k, F.lit("."))
    text = F.when(F.col("event_type") == "view", F.concat(body, F.lit("\nRATINGS: "), scores)).when(F.col("event_type").isin("click", "error"), F.concat(body, F.lit("\n"), scores)).otherwise(body)
    r = extract.parse_text_and_ratings(_answers(spark, sf).withColumn("answer", text), "event_id", "answer")
    return r.select("event_id", "text", F.col("ratings.buildQuality").alias("build"), F.col("ratings.value").alias("worth"))


# --- Streams and files -----------------------------------------------------------------------


@check("stream_toggles", "", """
SELECT user_id, list_name, item_id FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'favorites' WHEN 'purchase' THEN 'owned' WHEN 'view' THEN 'wishlist' END AS list_name, event_id % 50 AS item_id FROM events)
WHERE list_name IS NOT NULL GROUP BY ALL HAVING count(*) % 2 = 1""")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    rows = toggles.toggle_rows(events, {"click": "favorites", "purchase": "owned", "view": "wishlist"}, F.col("event_id") % 50)
    out = work_folder(spark)
    toggles.stream_membership(rows, f"{out}/lists", f"{out}/state", compact_every=1).awaitTermination()
    return toggles.SavedLists(spark, f"{out}/lists").lists()


@check("stream_new_items", "", "SELECT page_id, lower(regexp_extract(url, '//([^/]+)', 1)) AS host FROM pages")
def _(spark, sf):
    pages = spark.readStream.schema(table(spark, sf, "pages").schema).parquet(f"{sf}/page[s].parquet")
    out = work_folder(spark)
    work = lambda batch: batch.select("page_id", F.lower(F.regexp_extract("url", "//([^/]+)", 1)).alias("host"))
    resume.process_new_items(pages, work, f"{out}/done", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/done").select("page_id", "host")


@check("file_inventory", "", """
SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '') || chr(10)) AS digest FROM documents""")
def _(spark, sf):
    # One file for each document, named by its id.
    out = work_folder(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    files.write_texts(docs, out, "name", "text")
    return files.file_inventory(spark, out).select(F.regexp_extract("name", r"^(.*)\.txt$", 1).try_cast("long").alias("doc_id"), "size", "digest")


@check("write_and_read_records", "items", "SELECT name, year, fmt FROM items")
def _(spark, sf):
    out = work_folder(spark)
    i = view(spark, sf, "items").select("name", F.col("year").alias("year_introduced"), F.col("fmt").alias("film_format"))
    files.write_records(i, out, "shop", "cameras")
    back = files.read_source_records(spark, out, ["missing", "shop"], "cameras", multiline=False)
    return back.select("name", F.col("year_introduced").alias("year"), F.col("film_format").alias("fmt"))


@check("write_catalog", "items", "SELECT item_id, name, brand FROM items")
def _(spark, sf):
    out = work_folder(spark)
    files.write_catalog(view(spark, sf, "items").select("item_id", "name", "brand"), f"{out}/catalog")
    return spark.read.parquet(f"{out}/catalog")

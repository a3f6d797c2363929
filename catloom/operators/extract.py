"""Records out of landed pages, API answers and model answers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from catloom import vocabulary as V
from catloom.functions.parse import clean_markup, first_int, price, year_range
from catloom.functions.rules import type_from_markup
from catloom.functions.text import ordered_distinct, split_list, squeeze, strip, upscale_url
from catloom.functions.values import as_col, bind, blank_to_null, case_when, compute_once, first_set
from catloom.operators.joins import convert_currency
from catloom.operators.markup import Field, Mark, card_fields

# --- Wiki templates --------------------------------------------------------------------------


def kv_block(text: Column | str, block_names: Sequence[str]) -> Column:
    """Parameters of the first template with one of the names, as a map with lower-case keys.

    The template may nest others at any depth: the text behind its name is cut at double braces, and the
    body goes on until the depth falls below its own.
    """
    col = as_col(text)
    names = "|".join(re.escape(n) for n in block_names)
    head = rf"\{{\{{\s*(?:{names})\s*\n?\|"
    rest = F.when(col.rlike(f"(?i){head}"), F.regexp_replace(col, rf"(?is)\A.*?{head}", ""))
    pieces = F.regexp_extract_all(F.coalesce(rest, F.lit("")), F.lit(r"\{\{|\}\}|[^{}]+|[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("body"))

    def step(state: Column, piece: Column) -> Column:
        change = F.when(piece == "{{", 1).when(piece == "}}", -1).otherwise(0)
        depth = F.when(state["depth"] < 0, state["depth"]).otherwise(state["depth"] + change)
        return F.struct(depth.alias("depth"), F.when(depth < 0, state["body"]).otherwise(F.concat(state["body"], piece)).alias("body"))

    body = F.aggregate(pieces, start, step, lambda state: state["body"])
    lines = F.filter(F.split(body, r"\n\s*\|"), lambda x: F.contains(x, F.lit("=")))
    entry = lambda x: F.struct(
        strip(F.lower(F.split_part(x, F.lit("="), F.lit(1)))).alias("key"),
        strip(F.regexp_replace(F.regexp_replace(x, r"^[^=]*=", ""), r"\}\}\s*$", "")).alias("value"),
    )
    pairs = F.filter(F.transform(lines, entry), lambda e: (e["key"] != "") & ~F.startswith(e["key"], F.lit("{")))
    return F.map_from_entries(_last_per_key(pairs, "key"))


def _last_per_key(pairs: Column, key: str) -> Column:
    """Of entries with equal keys only the last one (short arrays: one template, one table row)."""

    def lasts(state: Column) -> Column:
        size = F.size(state)
        return F.filter(state, lambda e, i: ~F.exists(F.slice(state, i + 2, size), lambda o: o[key] == e[key]))

    return bind(pairs, lasts)


def coalesce_aliases(params: Column, keys: Sequence[str], cleaned: bool = True) -> Column:
    """First non-empty parameter among several spellings."""
    value = F.coalesce(*[blank_to_null(F.try_element_at(params, F.lit(k))) for k in keys])
    return blank_to_null(clean_markup(value)) if cleaned else value


# Parameter spellings of an item page.
ITEM_PARAMS = {
    "brand": ("manufacturer", "maker", "brand"),
    "years": ("produced", "intro_year", "year", "production"),
    "fmt": ("film_format", "film_size", "format"),
    "type": ("type", "camera_type"),
    "lens": ("lens_mount", "mount"),
    "shutter": ("shutter", "shutter_speeds"),
    "metering": ("metering", "meter"),
}


def _title_brand(title: str) -> Column:
    words = F.split(strip(F.col(title)), r"\s+")
    return F.when(F.size(words) >= 2, words[0])


def item_from_params(df: DataFrame, title: str, params: str) -> DataFrame:
    """Typed item columns from a parameter map; the brand falls back to the first title word."""
    rows = compute_once(df, _p=F.col(params)).drop(params)
    p = F.col("_p")
    get = lambda field: coalesce_aliases(p, ITEM_PARAMS[field])
    texts = compute_once(
        rows, name=first_set(coalesce_aliases(p, ["name"]), F.col(title)), brand=F.coalesce(get("brand"), _title_brand(title)),
        fmt=get("fmt"), lens=get("lens"), shutter=get("shutter"), metering=get("metering"), _years=get("years"),
        _type=get("type"), _weight=coalesce_aliases(p, ["weight"]),
    ).where("brand is not null")
    span = year_range("_years")
    return texts.withColumns({
        "year_from": span["year_from"], "year_to": span["year_to"],
        "item_type": type_from_markup("_type"), "weight_g": first_int("_weight", "g"),
    }).drop("_p", "_years", "_type", "_weight")


def film_from_params(df: DataFrame, title: str, params: str) -> DataFrame:
    """Typed film columns from a parameter map."""
    rows = compute_once(df, _p=F.col(params)).drop(params)
    get = lambda *keys: coalesce_aliases(F.col("_p"), keys)
    texts = compute_once(
        rows, name=first_set(get("name"), F.col(title)), brand=F.coalesce(get(*ITEM_PARAMS["brand"]), _title_brand(title)),
        film_type=get("type", "film_type"), grain=get("grain"), _years=get("produced", "intro_year", "year"),
        _iso=get("iso", "speed"), _formats=get("available_formats", "formats"),
    ).where("brand is not null")
    span = year_range("_years")
    return texts.withColumns({
        "year_from": span["year_from"], "year_to": span["year_to"],
        "iso_speed": first_int("_iso"), "available_formats": split_list("_formats"),
    }).drop("_p", "_years", "_iso", "_formats")


# --- Wiki tables -----------------------------------------------------------------------------


TABLE_PATTERN = r"(?s)\{\|.*?\|\}"


def _last_heading(piece: Column) -> Column:
    """Text of the last section heading in a piece of wiki text."""
    found = F.regexp_extract_all(piece, F.lit(r"(?m)^[ \t]*={2,4}\s*(\[\[[^\]|]+(?:\|[^\]]+)?\]\]|[^=\n]+?)\s*={2,4}"), F.lit(1))
    title = F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"^\[\[([^\]|]+).*$", "$1")
    return clean_markup(title)


def explode_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, section, cells): one row per table row, cells keyed by header.

    Everything is cut out of the page text in place (tables, then rows, then cells), without a shuffle.
    """
    col = F.col(text)
    pages = compute_once(
        df.select(key, text),
        _tables=F.regexp_extract_all(col, F.lit("(" + TABLE_PATTERN + ")")),
        _headings=F.transform(F.split(col, TABLE_PATTERN), lambda piece: _last_heading(piece)),
    )
    tables = pages.select(key, "_headings", F.posexplode("_tables").alias("_t", "_table"))

    def cell(c: Column) -> Column:
        plain = ~F.contains(c, F.lit("|")) | F.startswith(F.ltrim(c), F.lit("[["))
        return clean_markup(F.when(plain, c).otherwise(F.substring_index(c, "|", -1)))

    def cells(lines: Column, mark: str) -> Column:
        return F.flatten(F.transform(lines, lambda x: F.transform(F.split(F.substr(x, F.lit(2)), mark), cell)))

    def is_data(x: Column) -> Column:
        return F.startswith(x, F.lit("|")) & ~F.startswith(x, F.lit("|}"))

    def row_values(row: Column) -> Column:
        # The first line holds the table mark or the attributes of the row.
        lines = F.transform(F.split(row, "\n"), lambda x: strip(x))
        return cells(F.filter(lines, lambda x, i: (i > 0) & is_data(x)), r"\|\|")

    def as_map(heads: Column, values: Column) -> Column:
        n = F.least(F.size(values), F.size(heads))
        pairs = F.transform(F.slice(values, 1, n), lambda v, i: F.struct(heads[i].alias("k"), v.alias("v")))
        return F.map_from_entries(_last_per_key(pairs, "k"))

    lines = F.transform(F.split("_table", "\n"), lambda x: strip(x))
    known = F.array_compact(F.slice("_headings", F.lit(1), F.col("_t") + 1))
    rows = compute_once(
        tables.select(key, "_t", "_table", "_headings"),
        section=F.try_element_at(known, F.lit(-1)),
        _heads=cells(F.filter(lines, lambda x: F.startswith(x, F.lit("!"))), "!!"),
        _values=F.filter(F.transform(F.split("_table", r"\n\s*\|-"), row_values), lambda v: F.size(v) > 0),
    ).where(F.size("_heads") > 0)
    rows = rows.select(key, (F.col("_t") + 1).alias("table_no"), "section", "_heads", F.posexplode("_values").alias("_r", "_v"))
    return rows.select(key, "table_no", (F.col("_r") + 1).alias("row_no"), "section", as_map(F.col("_heads"), F.col("_v")).alias("cells"))


def films_from_tables(rows: DataFrame) -> DataFrame:
    """Film rows of list pages; the brand is a column, else the section, else the first name word."""
    rows = compute_once(rows, cells=F.col("cells"))
    get = lambda *keys: coalesce_aliases(F.col("cells"), keys)
    named = compute_once(
        rows, name=get("Film", "Name", "Product"), _maker=get("Manufacturer", "Company", "Maker"), _iso=get("ISO", "Speed", "ISO speed")
    ).where(F.length("name") >= 2)
    words = F.split("name", r"\s+")
    brand = F.coalesce(first_set("_maker", "section"), F.when(F.size(words) >= 2, words[0]))
    return named.withColumns({"brand": brand, "iso_speed": first_int("_iso")}).where("brand is not null").drop("_maker", "_iso")


# --- HTML ------------------------------------------------------------------------------------

TABLE_SCHEMA = T.StructType(
    [
        T.StructField("page_key", T.StringType()),
        T.StructField("table_no", T.IntegerType()),
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("heads", T.ArrayType(T.StringType())),
    ]
)


class _TableReader(HTMLParser):
    """Collects the rows of each table with cell texts and first links."""

    def __init__(self) -> None:
        super().__init__()
        self.tables = 0
        self.rows: list[tuple[int, list]] = []
        self.open: list[dict] = []  # tables being read, the innermost last

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.open.append({"no": self.tables, "row": None, "cell": None, "link": None})
        elif not self.open:
            return
        elif tag == "tr":
            self._end_row()
            self.open[-1]["row"] = []
        elif tag in ("td", "th"):
            self._end_cell()
            top = self.open[-1]
            if top["row"] is None:  # a cell may open its row
                top["row"] = []
            top["cell"], top["link"] = [], None
        elif tag == "a" and self.open[-1]["cell"] is not None and self.open[-1]["link"] is None:
            self.open[-1]["link"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)

    def _end_cell(self):
        top = self.open[-1]
        if top["cell"] is not None:
            top["row"].append(("".join(top["cell"]).strip(), top["link"]))
            top["cell"] = None

    def _end_row(self):
        self._end_cell()
        top = self.open[-1]
        if top["row"] is not None:
            self.rows.append((top["no"], top["row"]))
            top["row"] = None

    def finish(self):
        self.close()
        while self.open:
            self._end_row()
            self.open.pop()


def _read_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Data rows with the header row of their table, which is its first row."""
    for batch in batches:
        out = []
        for key, html in zip(batch["page_key"], batch["html"]):
            reader = _TableReader()
            reader.feed(html or "")
            reader.finish()
            heads: dict[int, list[str]] = {}
            for no, (table, row) in enumerate(reader.rows):
                cells = [text for text, _ in row]
                if table in heads:
                    out.append((key, table, no, cells, [link for _, link in row], heads[table]))
                else:
                    heads[table] = cells
        yield pd.DataFrame(out, columns=["page_key", "table_no", "row_no", "cells", "links", "heads"])


# Header word -> column role, first match wins.
TABLE_ROLES = (
    ("name|model|camera", "name"),
    ("year|date|introduced|produced", "year"),
    ("type|kind|category", "type"),
    ("image|photo|picture|thumb", "image"),
)


def html_table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, table_no, row_no, name, href, year_text, type): data rows by header role.

    Python only tokenizes the HTML (no parser exists in the JVM functions); roles are columns.
    """
    pages = df.select(F.col(key).cast("string").alias("page_key"), F.col(html).alias("html"))
    rows = pages.mapInPandas(_read_tables, TABLE_SCHEMA)
    table = ["page_key", "table_no"]
    role = lambda h: case_when([(F.lower(h).rlike(p), F.lit(r)) for p, r in TABLE_ROLES])
    roles = F.transform("heads", role)
    # The last header of a role wins; without a name column the first one is used.
    at = lambda r: F.size("roles") + 1 - F.nullif(F.array_position(F.reverse("roles"), r), F.lit(0))
    data = rows.withColumn("roles", roles)
    pick = lambda array, r: F.try_element_at(array, at(r).cast("int"))
    name_at = F.coalesce(at("name"), F.lit(1)).cast("int")
    return data.select(
        *table, "row_no",
        F.try_element_at("cells", name_at).alias("name"),
        F.try_element_at("links", name_at).alias("href"),
        pick("cells", "year").alias("year_text"),
        pick("cells", "type").alias("type"),
    ).where(F.length("name") >= 2)


def extract_links(df: DataFrame, key: str, html: str, pattern: str, group: int = 1) -> DataFrame:
    """(key, pos, url): distinct matches per page in order of first occurrence."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))
    rows = df.select(F.col(key), F.posexplode(found).alias("pos", "url"))
    return rows.groupBy(key, "url").agg(F.min("pos").alias("pos"))


def visible_text(html: Column | str) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(as_col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return strip(squeeze(F.regexp_replace(bare, r"<[^>]*>", " ")))


def intro_images(
    html: Column | str,
    pattern: str,
    stop: str = r"<h2[>\s]",
    identity: str = r"/(\d+_[a-f0-9]+)",
    skip: str = V.INTERFACE_IMAGE_PATTERN,
) -> Column:
    """Image URLs before the first ``stop``: no interface images, enlarged, one per photo id."""
    intro = F.element_at(F.split(as_col(html), stop, 2), 1)
    urls = F.filter(F.regexp_extract_all(intro, F.lit(pattern), F.lit(1)), lambda u: ~u.rlike(skip))
    larger = F.transform(urls, lambda u: upscale_url(u))
    return ordered_distinct(larger, lambda u: F.coalesce(blank_to_null(F.regexp_extract(u, identity, 1)), u))


def labelled_fields(df: DataFrame, key: str, texts: str, labels: Sequence[str], stops: Sequence[str] = ()) -> DataFrame:
    """(key, label, value): each text run belongs to the last label before it; ``--`` means null."""
    runs = df.select(F.col(key), F.posexplode(texts).alias("_pos", "_text"))
    is_label = F.col("_text").isin(list(labels))
    is_stop = F.col("_text").isin(list(stops)) if stops else F.lit(False)
    page = Window.partitionBy(key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(is_label | is_stop, F.struct(F.when(is_label, F.col("_text")).alias("label"), F.col("_pos").alias("at")))
    tagged = runs.withColumn("_mark", F.last(mark, ignorenulls=True).over(page)).where(~is_label & ~is_stop)
    tagged = tagged.where(F.col("_mark.label").isNotNull())
    joined = tagged.groupBy(key, "_mark").agg(F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_runs"))
    value = F.array_join(F.transform("_runs", lambda r: r["_text"]), " ")
    fields = joined.select(key, F.col("_mark.label").alias("label"), F.col("_mark.at").alias("_at"), F.nullif(strip(value), F.lit("--")).alias("value"))
    return fields.groupBy(key, "label").agg(F.max_by("value", "_at").alias("value"))


# --- Claims and API answers ------------------------------------------------------------------


def claim_value(claims: Column | str, prop: str) -> Column:
    """First typed value of a property: entity id, string, year of a time, amount of a quantity.

    A claim without a usable value gives way to the next one. ``claims`` is JSON text or a variant.
    """
    claimed = F.from_json(
        F.try_variant_get(F.try_parse_json(as_col(claims)), f"$.{prop}", "string"),
        "array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>",
    )

    def read(claim: Column) -> Column:
        kind, value = claim["mainsnak"]["datavalue"]["type"], claim["mainsnak"]["datavalue"]["value"]
        time = F.substr(F.get_json_object(value, "$.time"), F.lit(2), F.lit(4))
        return (
            F.when(kind == "wikibase-entityid", F.get_json_object(value, "$.id"))
            .when(kind == "string", value)
            .when(kind == "time", time.try_cast("int").cast("string"))
            .when(kind == "quantity", F.regexp_replace(F.get_json_object(value, "$.amount"), r"^\++", ""))
        )

    return F.try_element_at(F.filter(F.transform(claimed, read), lambda v: v.isNotNull()), F.lit(1))


def claim_ids(claims: Column | str, prop: str) -> Column:
    """All entity ids of a property."""
    doc = F.try_parse_json(as_col(claims))
    values = F.from_json(
        F.try_variant_get(doc, f"$.{prop}", "string"),
        "array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>",
    )
    return F.transform(values, lambda c: c["mainsnak"]["datavalue"]["value"]["id"])


def has_all_claims(claims: Column | str, type_prop: str, types: Sequence[str], required: str) -> Column:
    """One of the types, and the required property present."""
    wanted = F.array(*[F.lit(t) for t in types])
    present = F.try_variant_get(F.try_parse_json(as_col(claims)), f"$.{required}", "string").isNotNull()
    return F.coalesce(F.arrays_overlap(claim_ids(claims, type_prop), wanted), F.lit(False)) & present


LISTING_SCHEMA = "struct<itemSummaries:array<struct<title:string,price:struct<value:string,currency:string>>>>"


def listing_cards(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, pos, title, price, currency) of a listing answer in JSON."""
    items = F.from_json(F.col(answer), LISTING_SCHEMA)["itemSummaries"]
    rows = df.select(F.col(key), F.posexplode(items).alias("pos", "_item"))
    return rows.select(
        key, "pos", F.col("_item.title").alias("title"),
        F.col("_item.price.value").try_cast("double").alias("price"), F.col("_item.price.currency").alias("currency"),
    )


# Where a results page keeps its listings, their titles and their prices.
RESULTS = Mark("div", id="srp-river-results")
LISTING = Mark("li", parts=("s-card",))
LISTING_PRICE = Mark("span", classes=("s-card__price",))
LISTING_FIELDS = (
    Field("title", (Mark("div", classes=("s-card__title",)), Mark("span", parts=("primary", "su-styled-text")))),
    Field("price_text", (LISTING_PRICE,)),
    Field("price_style", (LISTING_PRICE,), "class"),
)


def html_cards(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, title, price) of a results page: only bold, not struck-through prices count as sold.

    Cards outside the results container and cards without a primary title are left out.
    """
    cards = card_fields(df, key, html, LISTING, LISTING_FIELDS, RESULTS).where("title != ''")
    style = F.coalesce("price_style", F.lit(""))
    sold = F.contains(style, F.lit("bold")) & ~F.contains(style, F.lit("strikethrough"))
    return cards.select(key, "pos", "title", F.when(sold, price("price_text")).alias("price"))


MEDIA_SCHEMA = "array<struct<type:string,content:string,thumbnail:string>>"


def nested_media(df: DataFrame, key: str, answer: str) -> DataFrame:
    """First usable image URL per API row; the thumbnail where the content is missing."""
    df = compute_once(df.select(key, answer), _media=F.from_json(F.col(answer), MEDIA_SCHEMA))
    media = F.col("_media")
    urls = F.transform(
        F.filter(media, lambda m: F.contains(F.lower(m["type"]), F.lit("image"))),
        lambda m: first_set(m["content"], m["thumbnail"]),
    )
    url = F.try_element_at(F.array_compact(urls), F.lit(1))
    absolute = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    return compute_once(df, url=absolute).select(key, "url").where("url is not null")


# --- Model answers ---------------------------------------------------------------------------


def parse_price_answers(df: DataFrame, key: str, answer: str, fx: DataFrame, cap: float = 50_000) -> DataFrame:
    """(key, price, currency, year, usd) of valid price objects inside answer texts."""
    found = F.regexp_extract(F.col(answer), r'(\{[^{}]*"price"[^{}]*\})', 1)
    raw = F.from_json(blank_to_null(found), "struct<price:string,currency:string,year:string>")
    known = df.where(~F.contains(F.upper(answer), F.lit("UNKNOWN"))).select(key, answer)
    typed = compute_once(known, _json=found, _raw=raw)
    # A quoted number is not a number: the digits must follow the key directly.
    unquoted = lambda field: F.col("_json").rlike(rf'"{field}"\s*:\s*-?\d')
    rows = compute_once(
        typed.select(key, "_json", "_raw"),
        price=F.when(unquoted("price"), F.col("_raw.price").try_cast("double")),
        currency=F.upper(F.coalesce("_raw.currency", F.lit("USD"))),
        year=F.when(unquoted("year"), F.col("_raw.year").try_cast("int")),
    ).drop("_json", "_raw").where((F.col("price") > 0) & F.col("year").between(1900, 2025) & (F.length("currency") == 3))
    return convert_currency(rows, fx, "price", "currency", "year", "usd").where(F.col("usd") <= cap)


def parse_label_answers(df: DataFrame, key: str, answer: str, valid: Sequence[str] = V.VALID_TYPES) -> DataFrame:
    """(id, label) of valid labels in a JSON array inside each answer; the answer of the greatest key wins per id."""
    found = blank_to_null(F.regexp_extract(F.col(answer), r"(?s)(\[.*\])", 1))
    items = F.from_json(found, "array<struct<id:string,type:string>>")
    rows = df.select(F.col(key).alias("_doc"), F.posexplode(items).alias("_pos", "_item"))
    low = strip(F.lower("_item.type"))
    label = case_when([(low == v.lower(), F.lit(v)) for v in valid])
    named = rows.select(F.col("_item.id").alias("id"), label.alias("label"), F.struct("_doc", "_pos").alias("_at"))
    return named.where("id != '' and label is not null").groupBy("id").agg(F.max_by("label", "_at").alias("label"))


def parse_text_and_ratings(df: DataFrame, key: str, answer: str, names: Sequence[str] = V.RATING_NAMES) -> DataFrame:
    """(key, text, ratings): description before the rating object, scores clamped to 1..5.

    One missing or unreadable score drops all of them. A labelled object always ends the text; a bare one only
    if it holds all scores, otherwise it is taken for a part of the text.
    """
    labelled = F.regexp_extract("_answer", V.LABELLED_RATINGS, 1)
    bare = F.regexp_extract("_answer", rf'(\{{[^{{}}]*"{names[0]}"[^{{}}]*\}})', 1)
    parts = compute_once(df.select(F.col(key), F.col(answer).alias("_answer")), _labelled=labelled, _bare=bare)
    has_label = F.col("_labelled") != ""
    values = F.from_json(F.when(has_label, F.col("_labelled")).otherwise(blank_to_null("_bare")), "map<string,string>")
    parts = compute_once(parts, _values=values)
    scores = [F.try_element_at("_values", F.lit(n)).try_cast("double") for n in names]
    complete = scores[0].isNotNull()
    for score in scores[1:]:
        complete = complete & score.isNotNull()
    end = F.when(has_label, F.regexp_instr("_answer", F.lit(V.LABELLED_RATINGS))).when(complete, F.instr("_answer", F.col("_bare")))
    text = F.coalesce(F.left("_answer", end - 1), F.col("_answer"))
    for tail in V.RATING_TAILS:
        text = F.regexp_replace(text, tail, "")
    clamp = lambda s: F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), s)), 1)
    ratings = F.struct(*[clamp(s).alias(n) for n, s in zip(names, scores)])
    return parts.select(F.col(key), strip(text).alias("text"), F.when(complete, ratings).alias("ratings"))


# --- Candidates ------------------------------------------------------------------------------


def pick_best_candidate(df: DataFrame, key: str, score: Column, value: str, pos: str, usable: Column | None = None, min_score: int | None = None) -> DataFrame:
    """Best scored value per key; the earlier one on a tie."""
    pool = df if usable is None else df.where(usable)
    scored = pool.withColumn("_score", score)
    if min_score is not None:
        scored = scored.where(F.col("_score") >= min_score)
    rank = F.struct(F.col("_score").alias("s"), (-F.col(pos)).alias("p"))
    return scored.groupBy(key).agg(F.max_by(F.struct(F.col(value), F.col("_score").alias("score")), rank).alias("_w")).select(key, "_w.*")

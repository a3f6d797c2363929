"""Rule tables compiled to columns: ordered classifiers, exclusions and scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from catloom import vocabulary as V
from catloom.functions.parse import clean_markup
from catloom.functions.text import strip, strip_accents, tokens
from catloom.functions.values import as_col, bind, blank_to_null, case_when, has_text

Rules = Sequence[tuple[str, str]]


def any_of(patterns: Sequence[str], ignore_case: bool = True) -> str:
    """One alternation, so a text is scanned once whatever the number of patterns.

    A pattern that starts with ``(?i)`` keeps its own flag.
    """
    default = "(?i:" if ignore_case else "(?:"
    parts = []
    for pattern in patterns:
        if pattern.startswith("(?i)"):
            parts.append("(?i:" + pattern[4:] + ")")
        else:
            parts.append(default + pattern + ")")
    return "|".join(parts)


def words(keywords: Sequence[str]) -> list[str]:
    return [r"\b" + re.escape(word) + r"\b" for word in keywords]


def _plain(pattern: str) -> str | None:
    """The literal a pattern stands for, if it is nothing more than one."""
    text = re.sub(r"\\([^0-9A-Za-z])", r"\1", pattern)
    bare = re.sub(r"\\[^0-9A-Za-z]", "", pattern)
    return None if re.search(r"[\\^$.|?*+()\[\]{}]", bare) else text


def matches_any(c: Column | str, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Whether one of the patterns occurs. Plain words use substring search, which is much faster
    than a regular expression; what remains is one alternation."""
    col = as_col(c)
    words_only = [p for p in patterns if _plain(p) is not None] if ignore_case else []
    others = [p for p in patterns if p not in words_only]
    tests = [contains_any(F.lower(col), [_plain(p).lower() for p in words_only])] if words_only else []
    if others:
        tests.append(col.rlike(any_of(others, ignore_case)))
    return reduce(lambda a, b: a | b, tests)


def contains_any(c: Column, fragments: Sequence[str]) -> Column:
    """Substring tests; a long list is evaluated on a bound value, which keeps generated code small."""

    def test(value: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(value, F.lit(fragment)) for fragment in fragments])

    return test(c) if len(fragments) <= 8 else bind(c, test)


def classify_first_match(c: Column | str, rules: Rules, default: Column | None = None) -> Column:
    """Label of the first rule whose pattern occurs; ``default`` (or null) when none does."""
    col = as_col(c)
    return case_when([(col.rlike(p), F.lit(label)) for p, label in rules], default)


def classify_fragment(c: Column | str, fragments: Rules, default: Column | None = None) -> Column:
    col = as_col(c)
    return case_when([(F.contains(col, F.lit(f)), F.lit(label)) for f, label in fragments], default)


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    return case_when([(c == key, F.lit(value)) for key, value in table.items()])


def normalize_format(c: Column | str, rules: Rules = V.FORMAT_RULES) -> Column:
    text = blank_to_null(c)
    return classify_first_match(text, rules, text)


def infer_format(
    name: Column | str,
    item_type: Column | str,
    brand: Column | str,
    type_map: Mapping[str, str] = V.TYPE_FORMATS,
    name_rules: Rules = V.NAME_FORMAT_RULES,
    prefixes: Sequence[str] = V.PREFIXES_120,
    prefix_label: str = "120",
    brand_map: Mapping[str, str] = V.BRAND_FORMATS,
    major_brands: Sequence[str] = V.BRANDS_135,
    major_label: str = "135",
) -> Column:
    """Five tiers: item type, name pattern, name prefix, brand default, major brand."""
    low_name, low_brand = F.lower(as_col(name)), F.lower(as_col(brand))
    starts = low_name.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")
    return F.coalesce(
        lookup(as_col(item_type), type_map),
        classify_first_match(name, name_rules),
        F.when(starts, F.lit(prefix_label)),
        lookup(low_brand, brand_map),
        F.when(low_brand.isin(list(major_brands)), F.lit(major_label)),
    )


def is_excluded_tech(
    name: Column | str,
    item_type: Column | str | None = None,
    brand: Column | str | None = None,
    names: Sequence[str] = V.EXCLUDED_TECH_NAMES,
    brands: Sequence[str] = V.EXCLUDED_TECH_BRANDS,
    patterns: Sequence[str] = V.EXCLUDED_TECH_PATTERNS,
) -> Column:
    """Exact name, brand, or any pattern in name and type."""
    name = F.coalesce(as_col(name), F.lit(""))
    text = name if item_type is None else F.concat_ws(" ", name, F.coalesce(as_col(item_type), F.lit("")))
    hit = F.lower(name).isin(list(names)) | matches_any(text, patterns)
    if brand is not None:
        hit = hit | F.coalesce(F.lower(as_col(brand)).isin(list(brands)), F.lit(False))
    return hit


def is_non_retail(
    name: Column | str,
    description: Column | str,
    brand: Column | str,
    keywords: Sequence[str] = V.NON_RETAIL_KEYWORDS,
    novelty: Sequence[str] = V.NOVELTY_PATTERNS,
    brands: Sequence[str] = V.NON_RETAIL_BRANDS + V.COUNTRY_BRANDS + V.NOISE_BRANDS,
) -> Column:
    text = F.concat(F.coalesce(as_col(name), F.lit("")), F.lit(" "), F.coalesce(as_col(description), F.lit("")))
    blocked = F.coalesce(F.lower(as_col(brand)).isin(list(brands)), F.lit(False))
    hit = matches_any(text, list(novelty)) if novelty else F.lit(False)
    if keywords:
        # Most texts contain none of the words even as a fragment.
        inside = contains_any(F.lower(text), [k.lower() for k in keywords])
        hit = hit | (inside & matches_any(text, words(keywords)))
    return hit | blocked


def classify_three_way(
    name: Column | str,
    deny: Column,
    allow_patterns: Sequence[str] = V.KNOWN_FILM_PATTERNS,
    labels: tuple[str, str, str] = ("digital", "analogue", "uncertain"),
) -> Column:
    """Denied first, then known good; the rest stays in and is queued for review."""
    return (
        F.when(deny, F.lit(labels[0]))
        .when(matches_any(name, allow_patterns, ignore_case=False), F.lit(labels[1]))
        .otherwise(F.lit(labels[2]))
    )


def display_type(c: Column | str, table: Mapping[str, str] = V.TYPE_LABELS) -> Column:
    """Exact raw type, or a text that already is a display type in another case."""
    key = strip(F.lower(blank_to_null(c)))
    shown = {label.lower(): label for label in table.values()}
    return F.coalesce(lookup(key, table), lookup(key, shown))


def type_from_markup(c: Column | str, fragments: Rules = V.TYPE_FRAGMENTS) -> Column:
    cleaned = clean_markup(blank_to_null(c))
    return classify_fragment(F.lower(cleaned), fragments, cleaned)


def _category_names(categories: Column) -> Column:
    return F.transform(categories, lambda x: F.replace(F.lower(x), F.lit("category:"), F.lit("")))


def is_item_page(
    categories: Column | str, known: Sequence[str] = V.ITEM_CATEGORIES, word: str = "camera"
) -> Column:
    return F.exists(
        _category_names(as_col(categories)), lambda x: x.isin(list(known)) | F.contains(x, F.lit(word))
    )


def label_from_categories(categories: Column | str, fragments: Rules) -> Column:
    """First category with a hit decides; within it, the first fragment."""
    labels = F.transform(_category_names(as_col(categories)), lambda x: classify_fragment(x, fragments))
    return F.try_element_at(F.array_compact(labels), F.lit(1))


def first_matching_pattern(c: Column | str, patterns: Sequence[str]) -> Column:
    """Text of the first pattern that occurs, ignoring case.

    One combined scan settles the (usual) rows without any hit.
    """
    col = as_col(c)
    which = case_when([(col.rlike("(?i)" + p), F.lit(p)) for p in patterns])
    return F.when(matches_any(col, patterns), which)


def is_boilerplate(c: Column | str, patterns: Sequence[str] = V.BOILERPLATE_PATTERNS) -> Column:
    return matches_any(c, patterns)


def triage(
    fraction: Column | str,
    size: Column | str,
    width: Column | str,
    drop_above: float = 0.10,
    auto_below: float = 0.05,
    min_size: int = 20_000,
    min_width: int = 200,
) -> Column:
    """Dropping is decided first, so a small file is never repaired automatically."""
    fraction, size, width = (F.coalesce(as_col(c), F.lit(0)) for c in (fraction, size, width))
    return (
        F.when((fraction > drop_above) | (size < min_size), F.lit("drop"))
        .when((fraction < auto_below) & (width > min_width), F.lit("auto"))
        .otherwise(F.lit("review"))
    )


def is_bundle(c: Column | str, patterns: Sequence[str] = V.BUNDLE_PATTERNS) -> Column:
    return matches_any(c, patterns)


def shows_item(
    url: Column | str,
    fragments: Sequence[str] = V.ACCESSORY_FRAGMENTS,
    sample: str = V.SAMPLE_PHOTO_PATTERN,
) -> Column:
    low = F.lower(as_col(url))
    return ~(contains_any(low, fragments) | low.rlike(sample))


def title_relevant(title: Column | str, query: Column | str, share: float = 0.5, least: int = 2) -> Column:
    """Enough query tokens occur in the title."""
    wanted = tokens(query)
    overlap = F.size(F.array_intersect(wanted, tokens(title)))
    return (F.size(wanted) > 0) & (overlap >= F.greatest(F.lit(float(least)), F.size(wanted) * share))


def match_text(c: Column | str) -> Column:
    """Accents folded, lower case, only letters, digits and single blanks."""
    return F.btrim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", " "))


def title_matches(
    title: Column | str,
    name: Column | str,
    brand: Column | str,
    brands: Sequence[str] = V.TITLE_BRANDS,
    share: float = 0.5,
) -> Column:
    """A foreign brand in the title rejects it; the own brand or half of the name words accept it."""
    parts = F.struct(
        match_text(title).alias("title"), match_text(name).alias("name"),
        F.coalesce(match_text(brand), F.lit("")).alias("brand"),
    )

    def decide(p: Column) -> Column:
        named = F.exists(
            F.array(*[F.lit(b) for b in brands]),
            lambda b: F.contains(p["title"], b) & (b != p["brand"]) & ~F.contains(p["name"], b),
        )
        foreign = F.when(contains_any(p["title"], brands), named).otherwise(F.lit(False))
        name_words = F.filter(F.split(p["name"], " "), lambda w: F.length(w) > 1)
        hits = F.size(F.filter(name_words, lambda w: F.contains(p["title"], w)))
        enough = (F.size(name_words) > 0) & (hits >= F.size(name_words) * share)
        return ~foreign & (((p["brand"] != "") & F.contains(p["title"], p["brand"])) | enough)

    return has_text(title) & bind(parts, decide)


def _points(test: Column, points: int) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0))


def score_url(url: Column | str, brand: Column | str) -> Column:
    """Additive score of how likely a URL is a clean brand logo."""
    low = F.lower(as_col(url))
    name = F.replace(F.lower(as_col(brand)), F.lit(" "), F.lit(""))
    score = _points(~F.contains(F.regexp_replace(low, r"-|_|%20", ""), name), -50)
    for fragments, points in V.LOGO_WORD_POINTS:
        score = score + _points(contains_any(low, fragments), points)
    endings = [
        (low.rlike("(?:" + "|".join(re.escape(e) for e in ends) + ")$"), F.lit(points))
        for ends, points in V.LOGO_EXTENSION_POINTS
    ]
    joined = F.regexp_replace(low, r"-|_", "")
    trades = [term.replace(" ", "") for term in V.LOGO_OTHER_TRADES]
    return (
        score
        + case_when(endings, F.lit(0))
        + _points(contains_any(low, V.LOGO_SITES), 15)
        + _points(contains_any(low, V.LOGO_BAD_SITES), -100)
        + _points(contains_any(low, V.LOGO_TOPIC_SITES), 10)
        + _points(contains_any(joined, trades), -40)
        + _points(contains_any(low, V.LOGO_PHOTO_WORDS), -20)
        + _points(contains_any(low, ("thumb", "small")), -10)
        + _points(F.contains(low, F.lit("black")) & F.contains(low, F.lit("white")), 5)
    )


def photo_score(title: Column | str, mime: Column | str, width: Column | str, name: Column | str) -> Column:
    """JPEG, moderate width, item name in the file title."""
    wanted = F.replace(F.lower(as_col(name)), F.lit(" "), F.lit("_"))
    return (
        _points(F.contains(as_col(mime), F.lit("jpeg")), 10)
        + _points((as_col(width) > 300) & (as_col(width) < 4000), 5)
        + _points((wanted != "") & F.contains(F.lower(as_col(title)), wanted), 20)
    )


def usable_photo(
    title: Column | str, url: Column | str, width: Column | str, height: Column | str, min_width: int = 100, min_height: int = 100,
    topics: Sequence[str] = V.NON_PHOTO_TITLES,
) -> Column:
    """A candidate with a url, of at least the smallest size, whose title names no drawing; unknown sizes are too small."""
    large = lambda size, least: F.coalesce(as_col(size) >= least, F.lit(False))
    drawn = contains_any(F.coalesce(F.lower(as_col(title)), F.lit("")), topics)
    return has_text(url) & large(width, min_width) & large(height, min_height) & ~drawn


def logo_score(title: Column | str, mime: Column | str) -> Column:
    low = F.lower(as_col(title))
    vector = (as_col(mime) == "image/svg+xml") | F.endswith(low, F.lit(".svg"))
    return (
        _points(F.contains(low, F.lit("logo")), 10)
        + _points(vector, 5)
        + _points(contains_any(low, V.NON_LOGO_TITLES), -10)
        + _points(contains_any(as_col(mime), ("pdf", "video")), -20)
    )


def is_prestige(brand: Column | str, brands: Sequence[str] = V.PRESTIGE_BRANDS) -> Column:
    return contains_any(F.coalesce(F.lower(as_col(brand)), F.lit("")), [b.lower() for b in brands])


def is_useless_description(c: Column | str, stub: str = "Wikimedia Commons category") -> Column:
    col = as_col(c)
    return ~has_text(col) | F.startswith(col, F.lit(stub)) | (F.length(strip(col)) < 5)


def is_template_description(c: Column | str, phrases: Sequence[str] = V.TEMPLATE_PHRASES) -> Column:
    """Text that a template wrote earlier."""
    col = as_col(c)
    shoots = F.contains(col, F.lit("It shoots")) & F.contains(col, F.lit("film."))
    produced = (
        F.contains(col, F.lit(" produced by "))
        & (F.regexp_count(col, F.lit(r"\.")) <= 2)
        & (F.length(col) < 150)
    )
    return ~has_text(col) | shoots | produced | contains_any(col, phrases)


def format_from_prose(c: Column | str, rules: Rules = V.PROSE_FORMAT_RULES) -> Column:
    """Format phrase in the text before the first heading."""
    return classify_first_match(F.split_part(as_col(c), F.lit("\n=="), F.lit(1)), rules)


def brand_from_prose(c: Column | str, title: Column | str) -> Column:
    """Maker named in the first five prose lines, else the first word of the title."""
    intro = F.split_part(as_col(c), F.lit("\n=="), F.lit(1))
    lines = F.transform(F.split(intro, "\n"), strip)
    prose = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(?:\{|\||!|\[\[File)"))
    sentence = F.array_join(F.slice(prose, 1, 5), " ")
    # Maker phrases in matching order.
    made = r"(?i)(?:made|manufactured|produced|built)\s+by\s+"
    patterns = (
        made + r"\[\[([^\]|]+)",
        made + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
        r"(?i)is\s+an?\s+\[\[([^\]|]+)\]\]",
    )

    def accepted(pattern: str) -> Column:
        text = clean_markup(F.regexp_extract(sentence, pattern, 1), keep_wrapped=False)
        usable = (text != "") & (F.length(text) < 50) & ~F.lower(text).rlike("^(?:camera|lens|the)")
        return F.when(usable, text)

    return F.coalesce(*[accepted(p) for p in patterns], F.split_part(strip(title), F.lit(" "), F.lit(1)))


def real_images(images: Column | str) -> Column:
    """Entries that have a file, or whose host is reliable."""
    return F.filter(
        as_col(images),
        lambda x: has_text(x["local_path"])
        | (has_text(x["url"]) & contains_any(x["url"], V.RELIABLE_HOSTS)),
    )


def drop_placeholders(images: Column | str) -> Column:
    return F.filter(as_col(images), lambda x: has_text(x["url"]) & ~F.contains(x["url"], F.lit("/icons/")))


# --- Descriptions ----------------------------------------------------------------------------


def template_description(name, brand, item_type, year, fmt) -> Column:
    """One sentence from the fields that are set."""
    kind = F.when(F.lower(as_col(item_type)) == "camera", F.lit(None)).otherwise(blank_to_null(item_type))
    kind = F.coalesce(kind, F.lit("camera"))
    brand, fmt, name = blank_to_null(brand), blank_to_null(fmt), as_col(name)
    year = F.nullif(as_col(year), F.lit(0)).cast("string")
    made = F.concat(F.lit("The "), name, F.lit(" is a "), kind, F.lit(" produced by "), brand, F.lit(" in "), year, F.lit("."))
    # Each form is null when one of its parts is, so coalesce picks the richest possible one.
    return F.coalesce(
        F.concat(made, F.lit(" It shoots "), fmt, F.lit(" film.")),
        made,
        F.concat(F.lit("The "), name, F.lit(" is a "), kind, F.lit(" by "), brand, F.lit(". "), fmt, F.lit(" format.")),
        F.concat(F.lit("A "), kind, F.lit(" by "), brand, F.lit(".")),
        F.concat(F.lit("An analogue "), kind, F.lit(".")),
    )


def spelled_type(item_type: Column | str, lens: Column | str, fmt: Column | str) -> Column:
    """Readable item type; a generic one is guessed from the mount and the format."""
    low = F.lower(F.coalesce(as_col(item_type), F.lit("")))
    fmt = as_col(fmt)
    has = lambda *parts: contains_any(low, parts)
    guessed = (
        F.when(F.contains(F.lower(F.coalesce(as_col(lens), F.lit(""))), F.lit("slr")), F.lit("SLR camera"))
        .when(fmt.isin("120", "220"), F.lit("medium format camera"))
        .when(fmt.isin("4x5", "8x10", "Sheet film"), F.lit("large format camera"))
        .when(fmt.isin("Instant Film", "Type 600", "SX-70", "i-Type", "Instax"), F.lit("instant camera"))
        .otherwise(F.lit("camera"))
    )
    return (
        F.when(low.isin("", "camera"), guessed)
        .when(has("slr", "reflex") & has("twin", "tlr"), F.lit("twin-lens reflex (TLR) camera"))
        .when(has("slr", "reflex"), F.lit("SLR camera"))
        .when(has("rangefinder"), F.lit("rangefinder camera"))
        .when(has("point", "compact"), F.lit("compact camera"))
        .when(has("folding"), F.lit("folding camera"))
        .when(has("box"), F.lit("box camera"))
        .when(has("stereo"), F.lit("stereo camera"))
        .when(has("subminiature"), F.lit("subminiature camera"))
        .otherwise(as_col(item_type))
    )


def rich_description(name, brand, item_type, year_from, year_to, fmt, lens, shutter, metering, weight) -> Column:
    """Opening sentence, technical details and weight, each only when known."""
    kind = spelled_type(item_type, lens, fmt)
    shown = F.coalesce(lookup(as_col(fmt), V.FORMAT_LABELS), blank_to_null(fmt))
    kind = F.concat_ws(" ", shown, kind)
    name, brand = as_col(name), blank_to_null(brand)
    start = F.nullif(as_col(year_from), F.lit(0)).cast("string")
    end = F.nullif(as_col(year_to), F.lit(0)).cast("string")
    the = F.concat(F.lit("The "), name, F.lit(" is a "), kind)
    opening = F.coalesce(
        F.concat(the, F.lit(" produced by "), brand, F.lit(" from "), start, F.lit(" to "), end, F.lit(".")),
        F.concat(the, F.lit(" introduced by "), brand, F.lit(" in "), start, F.lit(".")),
        F.concat(the, F.lit(" made by "), brand, F.lit(".")),
        F.concat(F.lit("The "), name, F.lit(" is an analogue "), kind, F.lit(".")),
    )
    shutter = blank_to_null(shutter)
    shutter = F.when(F.length(shutter) <= 60, shutter).otherwise(
        F.concat(F.left(shutter, F.lit(57)), F.lit("..."))
    )
    details = F.concat_ws(
        ", ",
        F.concat(blank_to_null(lens), F.lit(" lens mount")),
        F.concat(shutter, F.lit(" shutter")),
        F.concat(blank_to_null(metering), F.lit(" metering")),
    )
    features = F.when(details != "", F.concat(F.lit("It features "), details, F.lit(".")))
    weight = as_col(weight)
    weighs = (
        F.when(weight >= 1000, F.format_string("It weighs %.1f kg.", weight / F.lit(1000.0)))
        .when(weight > 0, F.format_string("It weighs %s g.", weight.cast("string")))
    )
    return F.concat_ws(" ", opening, features, weighs)


# --- Presentation ----------------------------------------------------------------------------


def decade(year: Column | str) -> Column:
    return (F.floor(as_col(year) / 10) * 10).cast("int")


def decade_label(year: Column | str, unknown: str = "Unknown year") -> Column:
    known = F.nullif(as_col(year), F.lit(0))
    return F.coalesce(F.concat(decade(known).cast("string"), F.lit("s")), F.lit(unknown))


def year_span_text(year_from: Column | str, year_to: Column | str) -> Column:
    start, end = F.nullif(as_col(year_from), F.lit(0)), F.nullif(as_col(year_to), F.lit(0))
    length = F.when(end > start, F.concat(F.lit(" ("), (end - start).cast("string"), F.lit(" years)")))
    return F.coalesce(
        F.concat(start.cast("string"), F.lit("–"), end.cast("string"), F.coalesce(length, F.lit(""))),
        start.cast("string"),
    )


def spec_map(item_type, fmt, lens, shutter, metering, weight, dimensions, battery) -> Column:
    """Set specifications only; the weight carries its unit."""
    grams = F.concat(F.nullif(as_col(weight), F.lit(0)).cast("string"), F.lit("g"))
    entries = {
        "type": display_type(item_type), "format": fmt, "lens": lens, "shutter": shutter,
        "metering": metering, "weight": grams, "dimensions": dimensions, "battery": battery,
    }
    pairs = [part for key, value in entries.items() for part in (F.lit(key), blank_to_null(value))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

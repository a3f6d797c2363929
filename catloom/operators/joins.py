"""Lookups, pattern joins, nearest-in-time joins and neighbour search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom import vocabulary as V
from catloom.functions.text import match_key_compact, match_key_spaced, normalize_name, starts_with_ci, strip
from catloom.functions.values import as_col, blank_to_null, first_set, has_amount, has_text, spread_nulls
from catloom.operators.rank import top_per_group
from catloom.runtime import cut_lineage, fits_bytes


def maybe_broadcast(dim: DataFrame) -> DataFrame:
    """Broadcast a dimension whose estimated size is small; otherwise the choice is Spark's."""
    return F.broadcast(dim) if fits_bytes(dim) else dim


# --- Brand names -----------------------------------------------------------------------------


def normalize_alias(
    df: DataFrame,
    brand: str,
    aliases: DataFrame,
    name: str = "brand_canonical",
    suffixes: Sequence[str] = V.CORPORATE_SUFFIXES,
) -> DataFrame:
    """Canonical brand. ``aliases`` has one row per lower-case ``alias`` with its ``canonical``.

    Text after a bar is dropped. Without a direct hit the first matching corporate suffix is cut
    and the rest looked up again; failing that, the rest itself is the result.
    """
    cleaned = strip(F.split_part(F.col(brand), F.lit("|"), F.lit(1)))
    shorter = F.lit(None).cast("string")
    for suffix in reversed(suffixes):
        cut = strip(F.left(cleaned, F.length(cleaned) - len(suffix)))
        shorter = F.when(F.endswith(cleaned, F.lit(suffix)), cut).otherwise(shorter)
    dim = maybe_broadcast(aliases.select("alias", "canonical"))
    direct = dim.select(F.col("alias").alias("_k1"), F.col("canonical").alias("_c1"))
    reduced = dim.select(F.col("alias").alias("_k2"), F.col("canonical").alias("_c2"))
    return (
        df.withColumn("_cleaned", cleaned)
        .withColumn("_short", shorter)
        .join(direct, F.lower("_cleaned") == F.col("_k1"), "left")
        .join(reduced, F.lower("_short") == F.col("_k2"), "left")
        .withColumn(name, F.coalesce("_c1", "_c2", "_short", "_cleaned"))
        .drop("_cleaned", "_short", "_k1", "_c1", "_k2", "_c2")
    )


def make_key(brand: Column | str, name: Column | str) -> Column:
    """Identity of an item inside the catalog: canonical brand and normalized name."""
    brand, name = F.coalesce(as_col(brand), F.lit("")), F.coalesce(as_col(name), F.lit(""))
    return F.concat_ws("|", strip(F.lower(brand)), normalize_name(name))


def lookup_join(df: DataFrame, dim: DataFrame, on: str, value: str, name: str, default: str | None = None) -> DataFrame:
    """Left lookup of ``value`` by key; the dimension has one row per key."""
    side = maybe_broadcast(dim.select(F.col(on).alias("_key"), F.col(value).alias("_value")))
    found = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return df.join(side, F.col(on) == F.col("_key"), "left").withColumn(name, found).drop("_key", "_value")


def fill_country(df: DataFrame, brand: str, country: str, countries: DataFrame) -> DataFrame:
    """Country of the brand where a record has none. ``countries``: canonical, country."""
    side = maybe_broadcast(countries.select(F.col("canonical").alias("_key"), F.col("country").alias("_value")))
    return (
        df.join(side, F.col(brand) == F.col("_key"), "left")
        .withColumn(country, first_set(country, "_value"))
        .drop("_key", "_value")
    )


def fill_launch_date(date: Column | str, year: Column | str) -> Column:
    return F.coalesce(blank_to_null(date), F.nullif(as_col(year), F.lit(0)).cast("string"))


def region_of(df: DataFrame, country: str, regions: DataFrame, name: str = "region") -> DataFrame:
    """``regions``: country, region; anything else is Other."""
    side = maybe_broadcast(regions.select(F.col("country").alias("_key"), F.col("region").alias("_value")))
    return (
        df.join(side, F.col(country) == F.col("_key"), "left")
        .withColumn(name, F.coalesce("_value", F.lit("Other")))
        .drop("_key", "_value")
    )


def localized_name(df: DataFrame, name: str, brand: str, prefixes: DataFrame, key: str) -> DataFrame:
    """Latin brand in front of names written only in Chinese characters.

    ``prefixes``: ord, prefix, brand. The prefix of lowest order replaces itself; without one the
    canonical brand is put in front.
    """
    eligible = F.coalesce(F.col(name).rlike("[一-鿿]") & ~F.col(name).rlike("[a-zA-Z]"), F.lit(False))
    heads = prefixes.select("ord", "prefix", F.col("brand").alias("_brand"))
    found = substring_join(df.where(eligible).select(key, name), heads, name, "prefix")
    found = found.where(F.startswith(F.col(name), F.col("prefix")))
    best = found.groupBy(F.col(key).alias("_id")).agg(F.min_by(F.struct("prefix", "_brand"), "ord").alias("_hit"))
    rest = strip(F.substr(F.col(name), F.length("_hit.prefix") + 1))
    localized = (
        F.when(~eligible, F.col(name))
        .when(F.col("_hit").isNotNull(), F.concat_ws(" ", F.col("_hit._brand"), blank_to_null(rest)))
        .when(has_text(brand), F.concat_ws(" ", F.col(brand), F.col(name)))
        .otherwise(F.col(name))
    )
    return df.join(best, F.col(key) == F.col("_id"), "left").withColumn(name, localized).drop("_id", "_hit")


# --- Pattern joins ---------------------------------------------------------------------------


def member_words(keys: DataFrame, bits: int) -> Column:
    """A bitmap of the hashed ``_hash`` values as one array of 64-bit words; ``bits`` bounds its size whatever the input."""
    place = F.pmod("_hash", F.lit(bits))
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = keys.select(F.floor(place / 64).cast("int").alias("_word"), set_bit.alias("_bits"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = rows.unionByName(blank).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"])).scalar()


def maybe_member(hashed: Column, words: Column, bits: int) -> Column:
    """False only if no key has this hash."""
    place = F.pmod(hashed, F.lit(bits))
    word = F.get(words, F.call_function("shiftright", place, F.lit(6)).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))) != 0


def substring_join(
    left: DataFrame, right: DataFrame, text: str, pattern: str, by: Sequence[str] = (), gram: int = 3
) -> DataFrame:
    """All pairs where ``text`` contains ``pattern`` and the ``by`` columns agree.

    "Contains" is turned into equality: a pattern is filed under its rarest piece of ``gram`` characters (all of it when
    shorter), a text is looked up under its own pieces, and survivors are checked. Which pieces have a pattern at all is
    kept in a bitmap that grows with the patterns up to 8 MB; a text's pieces are tested against it inside their
    array, so a row is made only where a pattern may follow. Any number of patterns works, and no pair without
    a shared piece is built. Null and empty texts and patterns match nothing.
    """
    # Each pattern is filed under its rarest piece: a beginning that many patterns share would meet too many texts.
    width = F.least(F.length(pattern), F.lit(gram))
    places = F.sequence(F.lit(1), F.length(pattern) - width + 1)
    distinct = right.where(F.length(pattern) > 0).select(pattern, *by).distinct()
    grams = distinct.withColumn("_piece", F.explode(F.transform(places, lambda i: F.substr(F.col(pattern), i, width))))
    often = grams.groupBy("_piece", *by).agg(F.count("*").alias("_often"))
    rarest = grams.join(often.hint("merge"), ["_piece", *by]).groupBy(pattern, *by).agg(
        F.min_by("_piece", F.struct("_often", "_piece")).alias("_piece"))
    filed = cut_lineage(right.join(rarest.hint("merge"), [pattern, *by]))

    known = filed.select("_piece", *by).distinct().withColumn("_hash", F.xxhash64("_piece", *by))
    stats = known.agg(F.count("*"), F.collect_set(F.length("_piece"))).first()
    bits = 1 << min(26, max(10, (16 * stats[0]).bit_length()))
    words = member_words(known, bits)
    probes = left.withColumn("_words", words)

    def pieces_of(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - width + 1)
        pieces = F.when(F.length(text) >= width, F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(width))))
        return F.filter(pieces, lambda p: maybe_member(F.xxhash64(p, *[F.col(b) for b in by]), F.col("_words"), bits))

    empty = F.array().cast("array<string>")
    pieces = F.array_distinct(F.concat(empty, *[F.coalesce(pieces_of(w), empty) for w in sorted(stats[1])]))
    probes = probes.withColumn("_piece", F.explode(pieces)).drop("_words")
    # Neither side may be broadcast on an estimate: the optimizer does not see how the pieces multiply.
    filed = F.broadcast(filed) if fits_bytes(right) else filed.hint("merge")
    joined = probes.join(filed, ["_piece", *by])
    return joined.where(F.contains(F.col(text), F.col(pattern))).drop("_piece")


def longest_pattern_join(
    df: DataFrame, book: DataFrame, key: str, brand: str, name: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Best price book entry per item: exact name, else the longest pattern contained in it.

    ``book``: manufacturer, pattern, price, currency, year, ord; equal lengths go to the earlier entry. ``carry``
    names further columns of the book to take along.
    """
    entries = book.select(
        F.col("manufacturer").alias("_brand"), "pattern",
        F.col("price").alias("book_price"), F.col("currency").alias("book_currency"),
        F.col("year").alias("book_year"), "ord", *carry,
    )
    texts = df.select(F.col(key).alias("_id"), F.col(brand).alias("_brand"), F.lower(name).alias("_text"))
    hits = substring_join(texts, entries, "_text", "pattern", ["_brand"])
    rank = F.struct(
        (F.col("pattern") == F.col("_text")).alias("exact"), F.length("pattern").alias("size"), (-F.col("ord")).alias("o")
    )
    value = F.struct("pattern", "book_price", "book_currency", "book_year", *carry)
    best = hits.groupBy("_id").agg(F.max_by(value, rank).alias("_best")).select("_id", "_best.*")
    return df.join(best, F.col(key) == F.col("_id"), "left").drop("_id").withColumnRenamed("pattern", "book_pattern")


def curated_match(curated: DataFrame, items: DataFrame, key: str, name: str, brands: Sequence[str]) -> DataFrame:
    """Best item per curated entry: exact name, else prefix, else substring; then shortest, then first.

    ``curated``: ord, display, match, brand_hint (may be null); a hint must occur in one of ``brands``.
    """
    texts = items.select(F.col(key).alias("item_id"), F.col(name).alias("item_name"), *[F.col(b).alias("_b_" + b) for b in brands])
    hits = substring_join(texts, curated, "item_name", "match")
    hint = F.lower(F.coalesce(F.col("brand_hint"), F.lit("")))
    fits = hint == ""
    for b in brands:
        fits = fits | F.contains(F.coalesce(F.lower("_b_" + b), F.lit("")), hint)
    tier = (
        F.when(F.col("item_name") == F.col("match"), 1)
        .when(F.startswith(F.col("item_name"), F.col("match")), 2)
        .otherwise(3)
    )
    rank = F.struct(tier.alias("t"), F.length("item_name").alias("l"), F.col("item_id").alias("i"))
    best = hits.where(fits).groupBy("ord", "display").agg(F.min_by(F.struct("item_id", "item_name", tier.alias("tier")), rank).alias("_m"))
    return curated.select("ord", "display").join(
        best.select("ord", "_m.*"), "ord", "left"
    )


def index_match(items: DataFrame, index: DataFrame, key: str, name: str, prefix: str = "") -> DataFrame:
    """Index entry per item: equal compact names, else either one inside the other; first in index order.

    ``index``: ord, entry_id, entry_name. ``prefix`` (a brand) is cut from the item name first.
    """
    shown = F.col(name)
    if prefix:
        shown = F.when(starts_with_ci(shown, F.lit(prefix)), F.substr(shown, F.lit(len(prefix) + 1))).otherwise(shown)
    left = items.select(F.col(key).alias("_id"), match_key_compact(shown).alias("_a")).where("_a != ''")
    right = index.select("ord", "entry_id", match_key_compact("entry_name").alias("_b"))
    inside = substring_join(left, right, "_a", "_b")
    around = substring_join(right, left, "_b", "_a")
    columns = ["_id", "_a", "_b", "ord", "entry_id"]
    hits = inside.select(*columns).unionByName(around.select(*columns))
    rank = F.struct(F.when(F.col("_a") == F.col("_b"), 0).otherwise(1).alias("t"), F.col("ord"))
    best = hits.groupBy("_id").agg(F.min_by("entry_id", rank).alias("entry_id"))
    return items.join(best, F.col(key) == F.col("_id"), "left").drop("_id")


def cross_mentions(df: DataFrame, brands: DataFrame, allowed: DataFrame, key: str, brand: str, name: str) -> DataFrame:
    """Foreign brands named as a word in an item's name, minus allowed pairs.

    ``brands``: other (lower case); ``allowed``: brand, other. High confidence when the name starts with it.
    """
    texts = df.select(
        F.col(key).alias("item_id"), F.lower(brand).alias("own"), F.translate(F.lower(name), "_", " ").alias("text")
    )
    hits = substring_join(texts, brands.select("other"), "text", "other").where(
        ~F.contains(F.col("own"), F.col("other")) & ~F.contains(F.col("other"), F.col("own"))
    )
    word = F.concat(F.lit(r"(?:^|[^a-z0-9_])\Q"), F.col("other"), F.lit(r"\E(?:$|[^a-z0-9_])"))
    hits = hits.where(F.rlike(F.col("text"), word))
    pairs = maybe_broadcast(allowed.select(F.col("brand").alias("own"), "other"))
    starts = F.startswith(F.concat(F.col("text"), F.lit(" ")), F.concat(F.col("other"), F.lit(" ")))
    return hits.join(pairs, ["own", "other"], "left_anti").select(
        "item_id", "own", "other", F.when(starts, F.lit("high")).otherwise(F.lit("low")).alias("confidence")
    )


# --- Series ----------------------------------------------------------------------------------


def points_up_to(points: Column, x: Column) -> Column:
    """How many of the sorted ``points`` (structs with ``p``) lie at or before ``x``, by bisection."""
    size = F.size(points)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(points, mid)["p"] <= x
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _nearer(at: Column, low: Column, high: Column) -> Column:
    """The neighbour with the smaller gap, the lower one on a tie; structs (p, v), either may be null."""
    return F.when(high.isNull() | (at - low["p"] <= high["p"] - at), low).otherwise(high)


def nearest_asof_join(
    df: DataFrame, series: DataFrame, on: str, at: str, value: str, name: str = "rate", matched: str = "rate_at",
    folded: bool | None = None,
) -> DataFrame:
    """Value of the nearest point of a series, in either direction; the earlier one on a tie.

    A series of a small estimated size is folded to one sorted array per key, which every task gets; a row then finds its
    neighbours by bisection, and the rows of ``df`` are not moved. A larger series is merged with the distinct (key, point)
    pairs in use instead: two running windows find the neighbour on each side, and rows without a key or a
    point stay out of the exchange. ``folded`` overrides the choice. Of equal points of a key the greatest value counts.
    """
    points = series.where(F.col(on).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(on).alias("_on"), F.col(at).alias("_at"))
    points = points.agg(F.max(value).alias("_v"))
    if fits_bytes(series) if folded is None else folded:
        line = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("p"), F.col("_v").alias("v"))))
        lines = points.groupBy("_on").agg(line.alias("_line"))
        lines = lines if folded else F.broadcast(lines)
        joined = df.join(lines, F.col(on) == F.col("_on"), "left")
        joined = joined.withColumn("_n", F.when(F.col(at).isNotNull(), points_up_to(F.col("_line"), F.col(at))))
        low, high = F.when(F.col("_n") > 0, F.get("_line", F.col("_n") - 1)), F.get("_line", F.col("_n"))
        joined = joined.withColumn("_pick", _nearer(F.col(at), low, high))
        return joined.withColumns({name: F.col("_pick.v"), matched: F.col("_pick.p")}).drop("_on", "_line", "_n", "_pick")

    asked = df.select(F.col(on).alias("_on"), F.col(at).alias("_at")).where(F.col(on).isNotNull() & F.col(at).isNotNull()).distinct()
    stacked = points.select("_on", "_at", F.struct(F.col("_at").alias("p"), F.col("_v").alias("v")).alias("_pt"), F.lit(False).alias("_ask"))
    stacked = stacked.unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    line = Window.partitionBy("_on").orderBy("_at", "_ask")
    back = Window.partitionBy("_on").orderBy(F.desc("_at"), "_ask")
    near = stacked.withColumn("_lo", F.last("_pt", ignorenulls=True).over(line)).withColumn("_hi", F.last("_pt", ignorenulls=True).over(back))
    near = near.where("_ask").withColumn("_pick", _nearer(F.col("_at"), F.col("_lo"), F.col("_hi"))).where("_pick is not null")
    # Written first: then both sides of the join are exchanged, and a hot (key, point) can be split at run time.
    answers = cut_lineage(near.select("_on", "_at", F.col("_pick.v").alias(name), F.col("_pick.p").alias(matched)))
    asks = F.col(on).isNotNull() & F.col(at).isNotNull()
    found = df.where(asks).join(answers, (F.col(on) == F.col("_on")) & (F.col(at) == F.col("_at")), "left").drop("_on", "_at")
    none = {c: F.lit(None).cast(answers.schema[c].dataType) for c in (name, matched)}
    return found.unionByName(df.where(~asks).withColumns(none))


def convert_currency(df: DataFrame, fx: DataFrame, amount: str, currency: str, year: str, name: str = "usd", base: str = "USD") -> DataFrame:
    """Amount in the base currency at the rate of the nearest year; null for an unknown currency.

    ``fx``: currency, year, rate (units per unit of the base currency). Rows in the base currency ask for no rate.
    """
    rates = fx.select(F.col("currency").alias("_ccy"), F.col("year").alias("_year"), "rate")
    own = F.upper(currency)
    keyed = df.withColumn("_ccy", F.when(own != base, own)).withColumn("_year", F.col(year))
    joined = nearest_asof_join(keyed, rates, "_ccy", "_year", "rate", "_rate", "_rate_year")
    usd = F.when(own == base, F.round(amount, 2)).otherwise(F.round(F.col(amount) / F.col("_rate"), 2))
    return joined.withColumn(name, usd).drop("_ccy", "_year", "_rate", "_rate_year")


def clamped_lookup_join(df: DataFrame, series: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """Value at a point, with points outside the series moved to its nearest end."""
    low, high = series.agg(F.min(at)).scalar(), series.agg(F.max(at)).scalar()
    points = maybe_broadcast(series.select(F.col(at).alias("_p"), F.col(value).alias(name)))
    bounded = df.withColumn("_at", F.when(F.col(at).isNotNull(), F.least(F.greatest(F.col(at), low), high)))
    return bounded.join(points, F.col("_at") == F.col("_p"), "left").drop("_at", "_p")


def adjust_for_inflation(df: DataFrame, cpi: DataFrame, amount: str, year: str, to_year: int, name: str = "adjusted") -> DataFrame:
    """Amount in prices of ``to_year``. ``cpi``: year, cpi."""
    ends = cpi.agg(F.min_by("cpi", "year").alias("first"), F.max_by("cpi", "year").alias("last"), F.max(F.when(F.col("year") == to_year, F.col("cpi"))).alias("hit"), F.min("year").alias("start"))
    target = ends.select(F.coalesce("hit", F.when(F.lit(to_year) < F.col("start"), F.col("first")).otherwise(F.col("last")))).scalar()
    keyed = df.withColumn("_from", F.col(year))
    series = cpi.select(F.col("year").alias("_from"), "cpi")
    rows = clamped_lookup_join(keyed, series, "_from", "cpi", "_from_cpi")
    adjusted = F.round(F.col(amount) * (target / F.col("_from_cpi")), 2)
    return rows.withColumn(name, adjusted).drop("_from", "_from_cpi")


# --- Enrichment lookups ----------------------------------------------------------------------


def backfill_by_key(df: DataFrame, raw: DataFrame, name: str, value: str, seq: str) -> DataFrame:
    """Fill an unset amount from raw rows of the same name; the last raw row wins.

    Adds ``backfilled``. Raw rows count only when the amount and the year are set.
    """
    usable = raw.where(has_amount(value) & has_amount("year"))
    latest = usable.groupBy(strip(F.lower(name)).alias("_key")).agg(F.max_by(value, seq).alias("_raw"))
    open_row = ~has_amount(value)
    joined = df.withColumn("_name", strip(F.lower(name))).join(latest, F.col("_name") == F.col("_key"), "left")
    filled = open_row & F.col("_raw").isNotNull()
    return (
        joined.withColumn("backfilled", filled)
        .withColumn(value, F.when(filled, F.col("_raw")).otherwise(F.col(value)))
        .drop("_name", "_key", "_raw")
    )


def resolve_labels(df: DataFrame, columns: Sequence[str], labels: DataFrame) -> DataFrame:
    """Replace several id columns by labels from one table (id, label); unknown ids give null."""
    side = maybe_broadcast(labels.select("id", "label"))
    for column in columns:
        dim = side.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        df = df.join(dim, F.col(column) == F.col("_id"), "left").withColumn(column + "_label", F.col("_label"))
        df = df.drop("_id", "_label")
    return df


def union_ids(*sources: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """(id): every id that occurs in one of the named columns of the tables, once; empty ids are left out.

    Copies are dropped before they are moved, so each column costs its distinct ids.
    """
    parts = [df.select(F.col(c).alias("id")) for df, columns in sources for c in columns]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.where(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).distinct()


def candidate_title_match(df: DataFrame, titles: DataFrame, key: str, brand: str, name: str) -> DataFrame:
    """Article title per item: name variants tried in order against normalized titles.

    Of titles with the same normalized form the greatest one is used. Names with quotes are skipped.
    """
    candidates = F.array_compact(
        F.array(
            F.when(has_text(brand) & starts_with_ci(name, brand), F.col(name)),
            F.when(has_text(brand), F.concat_ws(" ", F.col(brand), F.col(name))),
            F.col(name),
        )
    )
    probes = df.where(~F.col(name).rlike("['\"]")).select(F.col(key), F.posexplode(candidates).alias("pos", "_cand"))
    probes = probes.withColumn("_norm", match_key_spaced("_cand"))
    lookup = titles.groupBy(match_key_spaced("title").alias("_norm")).agg(F.max("title").alias("title"))
    return probes.join(lookup, "_norm").groupBy(key).agg(F.min_by("title", "pos").alias("title"))


# --- Inventory -------------------------------------------------------------------------------


def with_file(images: DataFrame, inventory: DataFrame, key: str, path: str, pos: str) -> DataFrame:
    """Per entity the first path that exists in the inventory, and how many exist."""
    present = images.join(inventory.select(path).distinct(), path, "left_semi")
    return present.groupBy(key).agg(F.min_by(path, pos).alias("first_path"), F.count("*").alias("n_files"))


def missing_entities(entities: DataFrame, with_files: DataFrame, key: str, brand: str | None = None, wanted: str | None = None) -> DataFrame:
    """Entities without any file, optionally of one brand (ignoring case)."""
    pool = entities if wanted is None else entities.where(F.lower(brand) == wanted.lower())
    return pool.join(with_files.select(key), key, "left_anti")


def reconcile(refs: DataFrame, inventory: DataFrame, path: str) -> DataFrame:
    """Every distinct path with its status: ok, dangling (referenced only) or orphan (stored only)."""
    left = refs.select(path).where(has_text(path)).distinct().withColumn("_ref", F.lit(True))
    right = inventory.select(path).distinct().withColumn("_inv", F.lit(True))
    status = (
        F.when(F.col("_ref").isNull(), F.lit("orphan"))
        .when(F.col("_inv").isNull(), F.lit("dangling"))
        .otherwise(F.lit("ok"))
    )
    return left.join(right, path, "full_outer").select(path, status.alias("status"))


def flag_has_detail(df: DataFrame, details: DataFrame, key: str) -> DataFrame:
    side = details.select(F.col(key).alias("_key")).distinct()
    return df.join(side, F.col(key) == F.col("_key"), "left").withColumn("has_detail", F.col("_key").isNotNull()).drop("_key")


def rebuild_paths(df: DataFrame, inventory: DataFrame, current: str, expected: Sequence[str]) -> DataFrame:
    """Path by convention: the first of the ``expected`` columns that exists. Adds new_path and status."""
    files = inventory.select("path").distinct()
    for column in expected:
        side = files.select(F.col("path").alias("_have_" + column))
        df = df.join(side, spread_nulls(df, column) == F.col("_have_" + column), "left")
    new_path = F.coalesce(*["_have_" + column for column in expected])
    status = (
        F.when(F.col("new_path").eqNullSafe(F.col(current)), F.lit("unchanged"))
        .when(F.col("new_path").isNull(), F.lit("cleared"))
        .otherwise(F.lit("set"))
    )
    return df.withColumn("new_path", new_path).withColumn("status", status).drop(*["_have_" + c for c in expected])


def collection_items(items: DataFrame, membership: DataFrame, list_name: str, key: str) -> DataFrame:
    """Items on a user's list. ``membership``: user_id, list_name, item key."""
    chosen = membership.where(F.col("list_name") == list_name).select("user_id", key)
    return chosen.join(items, key)


# --- Neighbours ------------------------------------------------------------------------------


def related_items(df: DataFrame, key: str, brand: str, year: str, name: str, k: int = 6) -> DataFrame:
    """The ``k`` items of the same brand nearest in year, then by name; rows of (key, pos, related key).

    No pair of siblings is built. Only the first ``k + 1`` items of a (brand, year) can be neighbours
    of anything, and only the ``k + 1`` nearest years on each side can contribute, so each
    (brand, year) gets one bounded candidate list shared by all of its items. An item without a year
    sees its siblings by name; items without a year come last for everyone else.
    """
    base = df.select(F.col(key).alias("_id"), F.col(brand).alias("_brand"), F.nullif(F.col(year), F.lit(0)).alias("_year"), F.col(name).alias("_name"))
    base = base.where(has_text("_brand"))
    item = F.struct(F.col("_name"), F.col("_id"), F.col("_year"))
    by_name = [F.col("_name"), F.col("_id")]

    heads = top_per_group(base, ["_brand", "_year"], by_name, k + 1)
    heads = heads.groupBy("_brand", "_year").agg(F.array_sort(F.collect_list(item)).alias("_head"))
    overall = top_per_group(base, ["_brand"], by_name, k + 1)
    overall = overall.groupBy("_brand").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    undated = heads.where("_year is null").select("_brand", F.col("_head").alias("_undated"))

    years = Window.partitionBy("_brand").orderBy("_year").rowsBetween(-(k + 1), k + 1)
    dated = heads.where("_year is not null").withColumn("_near", F.flatten(F.collect_list("_head").over(years)))
    dated = dated.join(undated, "_brand", "left")
    distance = lambda x: F.coalesce(F.abs(x["_year"] - F.col("_year")), F.lit(999_999))
    ranked = F.array_sort(
        F.transform(
            F.concat("_near", F.coalesce("_undated", F.array().cast(heads.schema["_head"].dataType))),
            lambda x: F.struct(distance(x).alias("d"), x["_name"].alias("n"), x["_id"].alias("i")),
        )
    )
    choice = dated.select("_brand", "_year", F.slice(ranked, 1, k + 1).alias("_list"))
    undated_choice = undated.select("_brand", F.lit(None).cast(df.schema[year].dataType).alias("_year")).join(overall, "_brand").select(
        "_brand", "_year",
        F.transform("_all", lambda x: F.struct(F.lit(999_999).alias("d"), x["_name"].alias("n"), x["_id"].alias("i"))).alias("_list"),
    )
    lists = choice.unionByName(undated_choice)
    joined = base.join(
        lists.select(F.col("_brand").alias("_b"), F.col("_year").alias("_y"), "_list"),
        (F.col("_brand") == F.col("_b")) & F.col("_year").eqNullSafe(F.col("_y")),
    )
    others = F.slice(F.filter("_list", lambda x: x["i"] != F.col("_id")), 1, k)
    return joined.select(F.col("_id").alias(key), F.posexplode(others).alias("pos", "_o")).select(
        key, (F.col("pos") + 1).alias("pos"), F.col("_o.i").alias("related"), F.col("_o.d").alias("distance")
    )

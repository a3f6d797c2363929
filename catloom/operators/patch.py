"""Corrections, provenance and enrichment from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catloom import vocabulary as V
from catloom.functions.text import strip
from catloom.functions.values import as_col, case_when, has_amount, has_text
from catloom.operators.joins import (
    adjust_for_inflation, backfill_by_key, convert_currency, longest_pattern_join, maybe_broadcast,
)


def repair_ranges(
    df: DataFrame,
    brand: str,
    name: str,
    start: str,
    end: str,
    date: str,
    fixes: DataFrame,
    exempt: DataFrame,
    earliest: int = 1880,
    swap_from: int = 4,
) -> DataFrame:
    """Repaired years with the rule that applied (column ``rule``) and the old values kept as ``old_*``.

    ``fixes``: brand, name and any of start/end (explicit corrections); ``exempt``: brand, name of
    genuinely early items. Order: explicit fix, too early, reversed by ``swap_from`` years or more
    (swap), reversed by less (drop the end).
    """
    fix = maybe_broadcast(fixes.select(F.col("brand").alias("_fb"), F.col("name").alias("_fn"), F.col("start").alias("_fs"), F.col("end").alias("_fe")))
    free = maybe_broadcast(exempt.select(F.col("brand").alias("_xb"), F.col("name").alias("_xn")))
    joined = df.join(fix, (F.col(brand) == F.col("_fb")) & (F.col(name) == F.col("_fn")), "left").join(
        free, (F.col(brand) == F.col("_xb")) & (F.col(name) == F.col("_xn")), "left"
    )
    reversed_by = F.col(start) - F.col(end)
    explicit, early = F.col("_fb").isNotNull(), F.col(start) < earliest
    changes = ~(F.coalesce("_fs", start).eqNullSafe(F.col(start)) & F.coalesce("_fe", end).eqNullSafe(F.col(end)))
    rule = (
        F.when(explicit, F.when(changes, "typo"))
        .when(early, F.when(F.col("_xb").isNull(), "too_early"))
        .when(reversed_by >= swap_from, "swapped")
        .when(reversed_by > 0, "small_diff")
    )
    ruled = joined.withColumn("rule", rule)
    for column in (start, end, date):
        ruled = ruled.withColumn("old_" + column, F.col(column))
    is_ = lambda r: F.col("rule") == r
    new_start = F.when(is_("typo"), F.coalesce("_fs", "old_" + start)).when(is_("too_early"), None).when(is_("swapped"), F.col("old_" + end)).otherwise(F.col("old_" + start))
    new_end = F.when(is_("typo"), F.coalesce("_fe", "old_" + end)).when(is_("swapped"), F.col("old_" + start)).when(is_("small_diff"), None).otherwise(F.col("old_" + end))
    new_date = F.when(is_("too_early"), None).when(is_("swapped"), F.col("old_" + end).cast("string")).otherwise(F.col("old_" + date))
    return ruled.withColumn(start, new_start).withColumn(end, new_end).withColumn(date, new_date).drop("_fb", "_fn", "_fs", "_fe", "_xb", "_xn")


def purge_placeholder(df: DataFrame, value: str, source: str, placeholder: float = 1.0) -> DataFrame:
    """A placeholder amount and its provenance become null."""
    real = ~F.coalesce(F.col(value) == placeholder, F.lit(False))
    return df.withColumn(source, F.when(real, F.col(source))).withColumn(value, F.when(real, F.col(value)))


def tag_provenance(df: DataFrame, value: str, source: str, label: str) -> DataFrame:
    return df.withColumn(source, F.when(has_amount(value) & ~has_text(source), F.lit(label)).otherwise(F.col(source)))


def override_from_book(
    df: DataFrame, book: DataFrame, fx: DataFrame, key: str, brand: str, name: str, value: str, currency: str, source: str,
    curated_label: str = "curated", existing_label: str = "archive",
) -> DataFrame:
    """Curated prices always win and say so; other existing prices without a source get one.

    The book columns stay (book_price, book_currency, book_year) for the inflation step.
    """
    # The book is converted, not the items it matches.
    entries = convert_currency(book, fx, "price", "currency", "year", "_usd")
    priced = longest_pattern_join(df, entries, key, brand, name, carry=["_usd"])
    hit = F.col("_usd").isNotNull()
    untagged = F.col("book_price").isNull() & has_amount(value) & ~has_text(source)
    return (
        priced.withColumn(source, F.when(hit, F.lit(curated_label)).when(untagged, F.lit(existing_label)).otherwise(F.col(source)))
        .withColumn(value, F.when(hit, F.round("_usd", 2)).otherwise(F.col(value)))
        .withColumn(currency, F.when(hit, F.col("book_currency")).otherwise(F.col(currency)))
        .drop("_usd")
    )


def apply_inflation(df: DataFrame, cpi: DataFrame, value: str, year: str, adjusted: str, to_year: int, fallback_year: str = "book_year") -> DataFrame:
    """Today's value of launch prices; the year comes from the record, else from the price book."""
    used = F.coalesce(F.nullif(F.col(year), F.lit(0)), F.col(fallback_year))
    rows = adjust_for_inflation(df.withColumn("_used", used), cpi, value, "_used", to_year, "_adjusted")
    new = F.when(has_amount(value) & F.col("_used").isNotNull(), F.col("_adjusted"))
    return rows.withColumn(adjusted, F.coalesce(new, F.col(adjusted))).drop("_used", "_adjusted")


def remap_values(df: DataFrame, fixes: DataFrame, brand: str, country: str, countries: DataFrame) -> DataFrame:
    """Correct brand spellings (old, new) and refresh the country of the corrected rows."""
    fix = maybe_broadcast(fixes.select(F.col("old").alias("_old"), F.col("new").alias("_new")))
    land = maybe_broadcast(countries.select(F.col("canonical").alias("_canon"), F.col("country").alias("_land")))
    joined = df.join(fix, F.col(brand) == F.col("_old"), "left").join(land, F.col("_new") == F.col("_canon"), "left")
    return (
        joined.withColumn(brand, F.coalesce("_new", brand)).withColumn(country, F.coalesce("_land", country))
        .withColumn("remapped", F.col("_old").isNotNull()).drop("_old", "_new", "_canon", "_land")
    )


def fill_from_pages(df: DataFrame, pages: DataFrame, key: str, start: str, end: str, source_order: Sequence[str]) -> DataFrame:
    """Years from extracted pages (key, source, year_from, year_to) for rows without a year.

    Sources are tried in order; one page per key and source (the smallest year on repeats).
    """
    prio = case_when([(F.col("source") == s, F.lit(i)) for i, s in enumerate(source_order)])
    usable = pages.withColumn("_prio", prio).where(has_amount("year_from") & F.col("_prio").isNotNull())
    best = usable.groupBy(F.col(key).alias("_k")).agg(
        F.min_by(F.struct("year_from", "year_to", "source"), F.struct("_prio", "year_from")).alias("_p")
    )
    joined = df.join(best, F.col(key) == F.col("_k"), "left")
    fill = ~has_amount(start) & F.col("_p").isNotNull()
    return (
        joined.withColumn("year_source", F.when(fill, F.col("_p.source")))
        .withColumn(end, F.when(fill, F.coalesce(F.col("_p.year_to"), F.col(end))).otherwise(F.col(end)))
        .withColumn(start, F.when(fill, F.col("_p.year_from")).otherwise(F.col(start)))
        .drop("_k", "_p")
    )


def waterfall(frames: Sequence[DataFrame], key: str, value: str, tie: str) -> DataFrame:
    """First source with a result per key: (key, value, source_no)."""
    merged = None
    for i, frame in enumerate(frames):
        part = frame.select(key, value, tie, F.lit(i).alias("source_no"))
        merged = part if merged is None else merged.unionByName(part)
    usable = merged.where(has_text(F.col(value).cast("string")))
    best = usable.groupBy(key).agg(F.min_by(F.struct(value, "source_no"), F.struct("source_no", tie)).alias("_w"))
    return best.select(key, "_w.*")


def apply_answers(df: DataFrame, answers: DataFrame, key: str, value: str, source: str, label: str) -> DataFrame:
    """Set a value and its provenance where an answer (key, answer) exists."""
    side = answers.select(F.col(key).alias("_k"), F.col("answer").alias("_a"))
    joined = df.join(side, F.col(key) == F.col("_k"), "left")
    hit = F.col("_a").isNotNull()
    return joined.withColumn(value, F.coalesce("_a", value)).withColumn(source, F.when(hit, F.lit(label)).otherwise(F.col(source))).drop("_k", "_a")


def drop_array_items(df: DataFrame, array: str, bad) -> DataFrame:
    """Filter array elements; ``removed`` counts what went."""
    kept = F.filter(array, lambda x: ~bad(x))
    return df.withColumn("removed", F.size(array) - F.size(kept)).withColumn(array, kept)


def needs_type(c: Column | str, junk: Sequence[str] = V.JUNK_TYPES) -> Column:
    """Empty, or a value that says nothing."""
    return F.coalesce(strip(F.lower(as_col(c))), F.lit("")).isin(list(junk))


def needs_text(description: Column | str, ratings: Column | str, min_chars: int = 300) -> Column:
    """Short text or no ratings."""
    return (F.length(strip(F.coalesce(as_col(description), F.lit("")))) < min_chars) | as_col(ratings).isNull()


def price_enrichment(
    df: DataFrame, book: DataFrame, fx: DataFrame, cpi: DataFrame, raw: DataFrame, to_year: int,
    archive_label: str = "archive", market_label: str = "market",
) -> DataFrame:
    """Purge, curated override, raw backfill, provenance, inflation, in this order.

    Works on columns item_id, brand, name, year, price_launch, launch_currency, launch_source,
    price_market, market_source, price_adjusted.
    """
    rows = purge_placeholder(df, "price_market", "market_source")
    rows = override_from_book(rows, book, fx, "item_id", "brand", "name", "price_launch", "launch_currency", "launch_source", existing_label=archive_label)
    rows = backfill_by_key(rows, raw, "name", "price_launch", "seq")
    rows = rows.withColumn("launch_source", F.when(F.col("backfilled"), F.lit(archive_label)).otherwise(F.col("launch_source")))
    rows = rows.withColumn("launch_currency", F.when(F.col("backfilled"), F.lit("CNY")).otherwise(F.col("launch_currency")))
    rows = tag_provenance(rows, "price_market", "market_source", market_label)
    return apply_inflation(rows, cpi, "price_launch", "year", "price_adjusted", to_year)

"""Coverage, counts, rollups, medians and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom.functions.rules import decade, decade_label, title_relevant
from catloom.functions.values import as_col, first_set, has_amount, has_text
from catloom.operators.joins import maybe_broadcast


def _rows(df: DataFrame, columns: Sequence[str], label: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(label), F.col(c).alias(value)) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def coverage(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(field, n, pct) of the rows that pass each test, in one scan."""
    counts = df.agg(F.count("*").alias("_total"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    pairs = [F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in tests]
    rows = counts.select("_total", F.inline(F.array(*pairs)))
    return rows.select("field", "n", F.round(F.col("n") * 100 / F.greatest("_total", F.lit(1)), 1).alias("pct"))


def array_value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Occurrences of array elements; ``value`` is an array column."""
    return df.select(F.explode(value).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def value_counts(df: DataFrame, column: str, default: str = "Unknown", top: int | None = 20) -> DataFrame:
    counts = df.groupBy(first_set(column, F.lit(default)).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if top is None else ordered.limit(top)


def brand_rollup(df: DataFrame, brand: str, seq: str, country: str, year: str, image: str, hero: Column, min_count: int = 3) -> DataFrame:
    """Per brand: size, country of the first row, best image, first and last year.

    Small brands drop out. The member lists come from ``paged_collect``.
    """
    set_year = F.nullif(F.col(year), F.lit(0))
    return (
        df.where(has_text(brand) & F.col(image).isNotNull())
        .groupBy(brand)
        .agg(
            F.count("*").alias("item_count"),
            F.min_by(F.coalesce(country, F.lit("")), seq).alias("country"),
            F.max_by(image, F.struct(hero.alias("h"), (-F.col(seq)).alias("o"))).alias("hero_image"),
            F.min(set_year).alias("year_start"),
            F.max(set_year).alias("year_end"),
        )
        .where(F.col("item_count") >= min_count)
    )


def hero_score(sources: Column | str, external_id: Column | str, description: Column | str, main_source: str = "wikipedia") -> Column:
    return (
        F.when(F.array_contains(as_col(sources), main_source), 30).otherwise(0)
        + F.when(has_text(external_id), 10).otherwise(0)
        + F.length(F.coalesce(as_col(description), F.lit("")))
    )


def region_rollup(brands: DataFrame, order: DataFrame, region: str = "region") -> DataFrame:
    """Brands and items per region; regions of ``order`` (region, ord) first, others after."""
    totals = brands.groupBy(region).agg(F.count("*").alias("brand_count"), F.sum("item_count").alias("item_count"))
    ranks = order.select(F.col("region").alias("_r"), F.col("ord").alias("_ord"))
    joined = totals.join(ranks, F.col(region) == F.col("_r"), "left")
    return joined.withColumn("display_order", F.coalesce("_ord", F.lit(1_000_000))).drop("_r", "_ord").orderBy("display_order", region)


def facet_options(df: DataFrame, facets: Mapping[str, Column]) -> DataFrame:
    """(facet, value) pairs in use. Values are rows, so a facet may have any number of them."""
    pairs = [F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in facets.items()]
    return df.select(F.inline(F.array(*pairs))).where(has_text("value")).distinct()


def group_by_decade(df: DataFrame, by: Sequence[str], year: str) -> DataFrame:
    """Counts per decade; the group without a year sorts last."""
    sort_key = F.coalesce(decade(F.nullif(F.col(year), F.lit(0))), F.lit(999_999))
    return (
        df.groupBy(*by, decade_label(year).alias("decade"), sort_key.alias("sort_key"))
        .agg(F.count("*").alias("n"))
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, name: str = "median", bins: int = 10_000) -> DataFrame:
    """Exact median per key of values in [low, high], without gathering a key's values anywhere.

    Equal values are counted first. Counts per key and bin (at most ``bins`` per key) locate the bin of
    the middle positions, and only that bin's values are ordered.
    """
    by = list(by)
    counts = df.where(F.col(value).between(low, high)).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_bin", F.least(F.floor((F.col("_v") - low) * (bins / (high - low))), F.lit(bins - 1)))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    binned = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_bn"))
    binned = binned.withColumn("_cum", F.sum("_bn").over(upto)).withColumn("n", F.sum("_bn").over(whole))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = binned.withColumn("_before", F.col("_cum") - F.col("_bn")).where((F.col("_cum") >= first) & (F.col("_before") < second))
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = counts.join(middle.select(*by, "_bin", "_before", "n"), [*by, "_bin"])
    values = values.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    holds = lambda p: ((F.col("_end") >= p) & (F.col("_end") - F.col("_n") < p)).cast("int")
    weighted = values.withColumn("_w", holds(first) + holds(second)).where("_w > 0")
    return weighted.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_w")) / 2).alias(name), F.max("n").alias("n"))


def robust_price(df: DataFrame, by: Sequence[str], title: str, query: str, price: str, currency: str, low: float = 5, high: float = 50_000, base: str = "USD") -> DataFrame:
    """Median price per key over relevant listings in the base currency and a plausible range."""
    usable = df.where((F.col(currency) == base) & title_relevant(title, query))
    medians = exact_median(usable, by, price, low, high, "_median")
    return medians.select(*by, F.round("_median", 2).alias("price"), "n")


def pricing_summary(df: DataFrame, launch: str, adjusted: str, market: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(has_amount(launch)).alias("with_launch"),
        F.count_if(has_amount(adjusted)).alias("with_adjusted"),
        F.count_if(has_amount(market)).alias("with_market"),
    )


def required_values_check(df: DataFrame, column: str, required: DataFrame) -> DataFrame:
    """Required values (column ``value``) that no row has."""
    present = df.select(F.col(column).alias("value")).distinct()
    return required.join(present, "value", "left_anti")


def required_fragments_check(df: DataFrame, column: str, fragments: Sequence[str]) -> DataFrame:
    """For each fragment, whether some row contains it (ignoring case); one scan for all."""
    low = F.lower(column)
    seen = df.agg(*[F.coalesce(F.bool_or(F.contains(low, F.lit(f.lower()))), F.lit(False)).alias(f) for f in fragments])
    return _rows(seen, fragments, "value", "present")


def duplicate_rate(df: DataFrame, keys: Sequence[Column], limit: float = 1.0) -> DataFrame:
    """Surplus rows per key in percent, and whether the target is met."""
    per_key = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    rate = F.round(F.col("dupes") * 100 / F.greatest("total", F.lit(1)), 1)
    return (
        per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dupes"))
        .withColumn("rate", rate).withColumn("ok", F.col("dupes") * 100 / F.greatest("total", F.lit(1)) <= limit)
    )


def amount_agreement(predicted: Column | str, truth: Column | str) -> Column:
    """match within 30 %, close within a factor of two, miss, or unknown."""
    predicted, truth = as_col(predicted), as_col(truth)
    ratio = F.when(truth > 0, predicted / truth).otherwise(F.lit(999.0))
    return (
        F.when(predicted.isNull(), "unknown").when(ratio.between(0.7, 1.3), "match")
        .when(ratio.between(0.5, 2.0), "close").otherwise("miss")
    )


def label_agreement(predicted: Column | str, truth: Column | str) -> Column:
    predicted = as_col(predicted)
    return F.when(predicted.isNull(), "unknown").when(predicted.eqNullSafe(as_col(truth)), "match").otherwise("miss")


def agreement_summary(df: DataFrame, bucket: str) -> DataFrame:
    """Counts per bucket and the accuracy among answered rows, in one row."""
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(bucket) == b).alias("n_" + b) for b in ("match", "close", "miss", "unknown")],
    )
    answered = F.col("total") - F.col("n_unknown")
    return counts.withColumn("accuracy", F.when(answered > 0, F.round(F.col("n_match") * 100 / answered, 1)))


def count_histogram(df: DataFrame, entity: str, counted: Column) -> DataFrame:
    """How many entities have how many counted rows (entities without any are left out)."""
    sizes = df.groupBy(entity).agg(F.count_if(counted).alias("size"))
    return sizes.where("size > 0").groupBy("size").agg(F.count("*").alias("entities"))


def group_audit(df: DataFrame, group: str, valid: Column, small: int = 5) -> DataFrame:
    """Groups without a valid member and groups of at most ``small`` members."""
    sizes = df.groupBy(group).agg(F.count("*").alias("members"), F.count_if(valid).alias("valid"))
    flags = sizes.withColumn("empty", F.col("valid") == 0).withColumn("small", F.col("members").between(1, small))
    return flags.where("empty or small")


def normalization_issues(df: DataFrame, raw: str, normalized: str) -> DataFrame:
    """Names that normalization left alone although they contain punctuation."""
    odd = F.col(raw).rlike(r"""[.,("']""")
    return df.where(has_text(raw) & (F.col(raw) == F.col(normalized)) & (F.length(raw) > 2) & odd)


def audit_summary(df: DataFrame, issues: Mapping[str, Column]) -> DataFrame:
    """All issue counts in one row and one scan."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in issues.items()])


def tier_distribution(df: DataFrame, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"))


def source_brand_report(df: DataFrame, source: str, brand: str, order: DataFrame) -> DataFrame:
    """Counts by source and brand, sources in order of risk. ``order``: source, ord."""
    counts = df.groupBy(source, brand).agg(F.count("*").alias("n"))
    ranks = maybe_broadcast(order.select(F.col("source").alias("_s"), F.col("ord").alias("risk")))
    return counts.join(ranks, F.col(source) == F.col("_s")).drop("_s").orderBy("risk", brand)


def facet_filter(
    df: DataFrame,
    country: str | None = None,
    formats: Sequence[str] = (),
    brand: str | None = None,
    decades: Sequence[int] = (),
    search: str = "",
) -> DataFrame:
    """Conjunction of the set facets over columns country, fmt, brand, year, name."""
    if country:
        df = df.where(F.col("country") == country)
    if formats:
        df = df.where(F.col("fmt").isin(list(formats)))
    if brand:
        df = df.where(F.lower("brand") == brand.lower())
    if decades:
        df = df.where(has_amount("year") & decade("year").isin(list(decades)))
    if search:
        df = df.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return df.orderBy("year") if decades else df


def brand_filter(df: DataFrame, region: str | None = None, search: str = "") -> DataFrame:
    if region:
        df = df.where(F.col("region") == region)
    if search:
        df = df.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return df

"""Ranking without hot tasks: global and per-key positions, top-k, pages, scores and layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom import vocabulary as V
from catloom.functions.rules import is_prestige
from catloom.functions.values import as_col, has_amount, has_text
from catloom.runtime import cut_lineage


def rank_rows(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Add the 1-based position of each row under ``order``, over all rows or within ``by``.

    A row_number window would put each key (or, without keys, everything) in one task. Rows are
    range-partitioned on (by, order) instead, so a hot key is spread over many tasks; each task counts
    its own rows and a table with at most one row per task carries the positions over to the next
    one. ``order`` must be total.
    """
    by, order = list(by), list(order)
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order)
    # Written once: the range bounds come from a sample and must not be drawn twice.
    parts = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    counts = parts.groupBy("_part", *by).count()
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that cross a partition border have an offset: fewer rows than partitions.
    offsets = (
        counts.withColumn("_before", F.sum("count").over(before)).where("_before > 0").drop("count")
    )
    keys = ["_part", *by]
    offsets = offsets.select(*[F.col(k).alias("_o_" + k) for k in keys], "_before")
    same = [local[k].eqNullSafe(offsets["_o_" + k]) for k in keys]
    return (
        local.join(F.broadcast(offsets), same, "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_part", "_local", "_before", *["_o_" + k for k in keys])
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark limits each task to ``k`` rows per key before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def paged_collect(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    element: Column,
    page_size: int = 1000,
    into: str = "items",
) -> DataFrame:
    """Ordered arrays of at most ``page_size`` elements; a large key spans several pages."""
    ranked = rank_rows(df.withColumn("_element", element), order, by, "_rank")
    paged = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page_size))
    arrays = paged.groupBy(*by, "page").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_element"))).alias("_pairs")
    )
    return arrays.withColumn(into, F.transform("_pairs", lambda x: x["_element"])).drop("_pairs")


# --- Scores and tiers ------------------------------------------------------------------------


def significance_score(
    sources: Column | str,
    external_id: Column | str,
    description: Column | str,
    brand: Column | str,
    has_image: Column | str,
    n_images: Column | str,
    year: Column | str,
    prestige: Sequence[str] = V.PRESTIGE_BRANDS,
    main_source: str = "wikipedia",
    cap: int = 99,
) -> Column:
    """Additive importance; ``sources`` is an array of source names."""

    def points(test: Column, value: int) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0))

    names = F.coalesce(as_col(sources), F.array().cast("array<string>"))
    length = F.length(F.coalesce(as_col(description), F.lit("")))
    score = (
        points(F.array_contains(names, main_source), 30)
        + points(has_text(external_id), 10)
        + F.least(F.greatest(F.size(names) - 1, F.lit(0)) * 15, F.lit(30))
        + F.when(length > 200, F.lit(15)).when(length > 150, F.lit(10)).when(length > 100, F.lit(5)).otherwise(F.lit(0))
        + points(is_prestige(brand, prestige), 5)
        + points(as_col(has_image), 5)
        + points(as_col(n_images) > 1, 3)
        + points(has_amount(year), 2)
    )
    return F.least(score, F.lit(cap))


def assign_tier(curated: Column | str, score: Column | str, has_image: Column | str, large: int = 35) -> Column:
    """xl for curated items, l from ``large`` points on, m below; hidden without image or points."""
    visible = F.coalesce(as_col(has_image), F.lit(False))
    return (
        F.when(~visible, F.lit("hidden"))
        .when(as_col(curated), F.lit("xl"))
        .when(as_col(score) == 0, F.lit("hidden"))
        .when(as_col(score) >= large, F.lit("l"))
        .otherwise(F.lit("m"))
    )


# --- Layout ----------------------------------------------------------------------------------


def spiral_cells(size: DataFrame, hero_cols: int = 3, hero_rows: int = 2) -> DataFrame:
    """Grid cells around a centre block, ranked by distance and then by angle.

    ``size`` is one row with the number of cells ``n``. Cells are numbered row by row, skipping the
    block; the numbering is arithmetic, so the grid is generated in parallel from ``n`` alone.
    """
    n = F.col("n")
    grid = (
        size.select(n, F.ceil(F.sqrt(n + hero_cols * hero_rows)).alias("cols"))
        .withColumn("rows", F.ceil((n + hero_cols * hero_rows) / F.col("cols")))
        .withColumn("hero_col", F.floor((F.col("cols") - hero_cols) / 2) + 1)
        .withColumn("hero_row", F.floor((F.col("rows") - hero_rows) / 2) + 1)
    )
    rows = grid.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).repartition("row")
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cols"))))
    col, row, hero_col, hero_row = (F.col(c) for c in ("col", "row", "hero_col", "hero_row"))
    in_hero = col.between(hero_col, hero_col + hero_cols - 1) & row.between(hero_row, hero_row + hero_rows - 1)
    rows_above = F.least(F.greatest(row - hero_row, F.lit(0)), F.lit(hero_rows))
    beside = F.when(
        row.between(hero_row, hero_row + hero_rows - 1) & (col >= hero_col + hero_cols), F.lit(hero_cols)
    ).otherwise(F.lit(0))
    slot = (row - 1) * F.col("cols") + col - rows_above * hero_cols - beside
    dx = col - (hero_col + hero_cols / 2 - 0.5)
    dy = row - (hero_row + hero_rows / 2 - 0.5)
    placed = (
        cells.where(~in_hero)
        .withColumn("slot", slot)
        .where(F.col("slot") <= n)
        .select("slot", "col", "row", F.sqrt(dx * dx + dy * dy).alias("distance"), F.atan2(dy, dx).alias("angle"))
    )
    order = [F.col("distance"), F.col("angle"), F.col("slot")]
    return rank_rows(placed, order, name="rank")


def place_by_rank(items: DataFrame, cells: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The k-th item goes to the k-th nearest cell."""
    return rank_rows(items, order, name="rank").join(cells, "rank")


def spread_by_group(df: DataFrame, group: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Round robin over groups: first of every group, then every second one, and so on."""
    turns = rank_rows(df, order, [group], "turn")
    return rank_rows(turns, [F.col("turn"), *order], name=name)


def close_repeats(df: DataFrame, group: str, position: str, min_gap: int) -> DataFrame:
    """Positions whose group occurs again within the ``min_gap`` places before.

    Positions are unique, so each row is sent to the next ``min_gap`` places and matched there.
    """
    ahead = df.select(
        F.explode(F.sequence(F.col(position) + 1, F.col(position) + min_gap)).alias(position),
        F.col(group).alias("_group"),
    )
    hits = ahead.join(df.select(position, group), position).where(F.col("_group") == F.col(group))
    return hits.groupBy(position, group).agg(F.count("*").alias("repeats"))


def seeded_order(key: Column | str, seed: int = 42) -> Column:
    """Deterministic shuffle key."""
    return F.md5(F.concat(as_col(key).cast("string"), F.lit(f"#{seed}")))


def swap_positions(df: DataFrame, pairs: DataFrame, name: str, position: str) -> DataFrame:
    """Exchange the places of the first rows named ``a`` and ``b``; a pair with one side missing is left."""
    wanted = pairs.select("pair", F.explode(F.array("a", "b")).alias(name), "a")
    first = df.join(wanted, name).groupBy("pair", name, "a").agg(F.min(position).alias("own"))
    both = first.groupBy("pair").agg(
        F.max(F.when(F.col(name) == F.col("a"), F.col("own"))).alias("pa"),
        F.max(F.when(F.col(name) != F.col("a"), F.col("own"))).alias("pb"),
    ).where("pa is not null and pb is not null")
    moves = both.select(F.inline(F.array(
        F.struct(F.col("pa").alias(position), F.col("pb").alias("_to")),
        F.struct(F.col("pb").alias(position), F.col("pa").alias("_to")),
    )))
    return df.join(moves, position, "left").withColumn(position, F.coalesce("_to", position)).drop("_to")


# --- Queues and pages ------------------------------------------------------------------------


def work_queue(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Items in order of urgency; with a limit Spark keeps only that many rows per task."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def batch_ids(df: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    ranked = rank_rows(df, order, name="_rank")
    return ranked.withColumn(name, F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 0) of a listing."""
    return df.orderBy(*order).offset(number * size).limit(size)


def sample_rows(df: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Repeatable spot check."""
    return df.orderBy(seeded_order(key, seed), key).limit(k)


def cap_per_entity(df: DataFrame, entity: str, order: Sequence[Column], k: int = 8) -> DataFrame:
    return top_per_group(df, [entity], order, k)

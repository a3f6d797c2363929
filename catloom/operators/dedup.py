"""Duplicates of rows, values and files; misplaced children; target names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catloom import vocabulary as V
from catloom.functions.text import name_from_slug
from catloom.functions.values import compute_once
from catloom.operators.rank import rank_rows
from catloom.operators.resolve import cluster_id


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """First row per key, ignoring case; an aggregate, so copies of a hot key meet map-side."""
    best = df.groupBy(F.lower(key).alias("_k")).agg(F.min_by(_whole_row(df), seq).alias("_row"))
    return best.select("_row.*")


def keep_richest(df: DataFrame, key: str, size: str, seq: str) -> DataFrame:
    """Row with the largest ``size`` per key; the earlier one on a tie."""
    rank = F.struct(F.col(size).alias("s"), (-F.col(seq)).alias("o"))
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(_whole_row(df), rank).alias("_row")).select("_row.*")


def append_seed_rows(df: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Add the seed rows whose key is absent, ignoring case."""
    known = df.select(F.lower(key).alias("_k")).distinct()
    fresh = seed.join(known, F.lower(seed[key]) == F.col("_k"), "left_anti")
    return df.unionByName(fresh, allowMissingColumns=True)


def union_with_seen(frames: Sequence[DataFrame], key: str, seq: str) -> DataFrame:
    """Concatenate in order; of equal keys the row of the earlier frame stays."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    best = merged.groupBy(F.lower(key).alias("_k")).agg(F.min_by(_whole_row(merged), F.struct("_frame", seq)).alias("_row"))
    return best.select("_row.*").drop("_frame")


def id_set_ops(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows (op, key): union, difference and intersection of two id sets."""
    a, b = left.select(key), right.select(key)
    parts = {"union": a.union(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b)}
    tagged = [rows.select(F.lit(op).alias("op"), key) for op, rows in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def drop_shared_values(rows: DataFrame, entity: str, value: str, suspect: Column) -> DataFrame:
    """Remove suspect values that more than one entity uses, from all of them."""
    shared = (
        rows.where(suspect).groupBy(F.col(value).alias("_v"))
        .agg(F.min(entity).alias("_lo"), F.max(entity).alias("_hi")).where("_lo != _hi").select("_v", F.lit(True).alias("_bad"))
    )
    joined = rows.join(shared, F.col(value) == F.col("_v"), "left")
    return joined.where(~(suspect & F.coalesce("_bad", F.lit(False)))).drop("_v", "_bad")


def hash_duplicate_groups(df: DataFrame, digest: str, brand: str, name: str, source: str, suspects: Sequence[str] = V.SUSPECT_IMAGE_SOURCES) -> DataFrame:
    """One row per hash with several members: size, kind and whether its members are flagged.

    Only extremes and counts are kept per hash, so a group of any size folds map-side.
    """
    groups = df.groupBy(digest).agg(
        F.count("*").alias("size"),
        (F.min(brand) != F.max(brand)).alias("_brands"),
        (F.min(name) != F.max(name)).alias("_names"),
        F.bool_or(F.col(source).isin(list(suspects))).alias("_suspect"),
    ).where("size > 1")
    kind = F.when(F.col("_brands"), "cross-brand duplicate").when(F.col("_names"), "same-brand duplicate").otherwise("copy")
    flagged = F.col("_brands") | (F.col("_names") & (F.col("_suspect") | (F.col("size") > 2)))
    return groups.select(digest, "size", kind.alias("kind"), flagged.alias("flagged"))


def flag_hash_duplicates(df: DataFrame, groups: DataFrame, digest: str) -> DataFrame:
    bad = groups.where("flagged").select(F.col(digest).alias("_d"), F.col("kind").alias("reason"))
    return df.join(bad, F.col(digest) == F.col("_d")).drop("_d")


def validate_extras(mains: DataFrame, extras: DataFrame, entity: str, digest: str, size: str, min_size: int = 5000, mass: int = 3) -> DataFrame:
    """Reason per extra file: tiny, other_main, own_main, mass (copies among the survivors) or kept."""
    any_main = mains.select(F.col(digest).alias("_d")).distinct().withColumn("_any", F.lit(True))
    own_main = mains.select(F.col(digest).alias("_d2"), F.col(entity).alias("_e")).distinct().withColumn("_own", F.lit(True))
    joined = extras.join(any_main, F.col(digest) == F.col("_d"), "left").join(
        own_main, (F.col(digest) == F.col("_d2")) & (F.col(entity) == F.col("_e")), "left"
    )
    first = F.when(F.col(size) < min_size, "tiny").when(F.col("_own"), "own_main").when(F.col("_any"), "other_main")
    checked = joined.withColumn("_first", first).drop("_d", "_any", "_d2", "_e", "_own")
    copies = checked.where("_first is null").groupBy(F.col(digest).alias("_d")).agg(F.count("*").alias("_n"))
    copies = copies.where(F.col("_n") > mass)
    reason = F.coalesce("_first", F.when(F.col("_n").isNotNull(), "mass"), F.lit("kept"))
    return checked.join(copies, F.col(digest) == F.col("_d"), "left").withColumn("reason", reason).drop("_first", "_d", "_n")


def first_reason(flags: Sequence[DataFrame], entity: str) -> DataFrame:
    """Union of flag tables (entity, reason); the reason of the earliest table stays."""
    merged = None
    for prio, frame in enumerate(flags):
        part = frame.select(entity, "reason", F.lit(prio).alias("_prio"))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(entity).agg(F.min_by("reason", F.struct("_prio", "reason")).alias("reason"))


def split_misplaced(images: DataFrame, prefixes: DataFrame, url: str, brand: str, own_model: str) -> DataFrame:
    """Which model an image file names: rows with ``model`` and ``status`` (correct or misplaced).

    The file is ``<brand>-<model>.jpg``; ``prefixes`` (brand, prefix, ord) lists the accepted brand
    spellings, tried in order. Files of no known spelling are left out.
    """
    file = F.regexp_replace(F.substring_index(F.col(url), "/", -1), r"\.jpg$", "")
    spellings = prefixes.select(F.col("brand").alias("_b"), F.concat("prefix", F.lit("-")).alias("_p"), F.col("ord").alias("_o"))
    # A brand has a handful of spellings; the lists are bounded by the dictionary.
    lists = spellings.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_o", "_p"))).alias("_list"))
    joined = images.withColumn("_file", file).join(lists, F.col(brand) == F.col("_b"))
    hit = F.try_element_at(F.filter("_list", lambda x: F.startswith(F.col("_file"), x["_p"])), F.lit(1))["_p"]
    known = compute_once(joined, _prefix=hit).where("_prefix is not null")
    model = F.substr(F.col("_file"), F.length("_prefix") + 1)
    named = known.withColumn("model", model).withColumn("status", F.when(F.col("model") == F.col(own_model), "correct").otherwise("misplaced"))
    return named.drop("_file", "_b", "_list", "_prefix")


def relocate_or_create(misplaced: DataFrame, catalog: DataFrame, brand: str, model: str, url: str, item_id: str, item_name: str) -> DataFrame:
    """Where each misplaced file goes: an existing item, else one new item per brand and name."""
    name = name_from_slug(model)
    key = F.concat_ws("|", F.trim(F.lower(brand)), F.trim(F.lower("new_name")))
    wanted = misplaced.withColumn("new_name", name).withColumn("_key", key).select("_key", F.col(brand).alias("brand"), "new_name", F.col(url).alias("url")).distinct()
    known = catalog.groupBy(F.concat_ws("|", F.trim(F.lower(brand)), F.trim(F.lower(item_name))).alias("_k")).agg(F.max(item_id).alias("_id"))
    joined = wanted.join(known, F.col("_key") == F.col("_k"), "left")
    return joined.select(
        F.coalesce(F.col("_id").cast("string"), cluster_id("_key")).alias("target_id"),
        F.when(F.col("_id").isNull(), "created").otherwise("existing").alias("status"),
        "brand", "new_name", "url",
    )


def claim_orphans(orphans: DataFrame, primaries: DataFrame, path: str, entity: str) -> DataFrame:
    """Stored files named like a referenced one plus ``_N`` join that entity, ordered by N."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]+$", "")
    base = orphans.withColumn("_stem", F.regexp_replace(stem(F.col(path)), r"_\d+$", ""))
    number = F.coalesce(F.nullif(F.regexp_extract(stem(F.col(path)), r"_(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    owners = primaries.groupBy(stem(F.col(path)).alias("_stem")).agg(F.min(entity).alias(entity))
    return base.withColumn("number", number).join(owners, "_stem").drop("_stem")


def plan_targets(files: DataFrame, folder: str, path: str, order: Sequence[Column]) -> DataFrame:
    """Collision-free target of every file in its folder: main, then 2, 3, ... with its extension."""
    ranked = rank_rows(files, order, [folder], "_n")
    ext = F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)
    leaf = F.when(F.col("_n") == 1, "main").otherwise(F.col("_n").cast("string"))
    return ranked.withColumn("target", F.concat(F.col(folder), F.lit("/"), leaf, ext)).drop("_n")


def plan_orphan_targets(files: DataFrame, path: str, folder: str) -> DataFrame:
    """Orphans keep their file name; later ones of the same name get ``_dup2``, ``_dup3``, ...

    A number is skipped where a file already has that name. Numbers in use per name are ranked: the i-th of them, b,
    moves every later copy whose place is b - i or more by one.
    """
    leaf = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    ranked = rank_rows(files.withColumn("_leaf", leaf), [F.col(path)], ["_leaf"], "_n")
    stem, ext = F.regexp_replace("_leaf", r"\.[^.]+$", ""), F.regexp_extract("_leaf", r"(\.[^.]+)$", 1)
    used = ranked.select("_leaf").distinct().withColumn("_used", F.regexp_extract("_leaf", r"_dup([1-9][0-9]{0,8})(?:\.[^.]+)?$", 1))
    used = used.where("_used <> ''").withColumn("_of", F.regexp_replace("_leaf", r"_dup[1-9][0-9]{0,8}(\.[^.]+)?$", "$1"))
    used = used.select("_of", F.col("_used").cast("long").alias("_used")).where("_used >= 2")
    used = rank_rows(used, [F.col("_used")], ["_of"], "_i").select("_of", (F.col("_used") - F.col("_i")).alias("_from"))
    later = ranked.where("_n > 1").join(used, (F.col("_leaf") == F.col("_of")) & (F.col("_from") <= F.col("_n") - 1), "left")
    keys = [c for c in ranked.columns]
    moved = later.groupBy(*keys).agg(F.count("_of").alias("_moved"))
    every = ranked.where("_n = 1").withColumn("_moved", F.lit(0).cast("long")).unionByName(moved)
    number = (F.col("_n") + F.col("_moved")).cast("string")
    name = F.when(F.col("_n") == 1, F.col("_leaf")).otherwise(F.concat(stem, F.lit("_dup"), number, ext))
    return every.withColumn("target", F.concat(F.lit(folder + "/"), name)).drop("_leaf", "_n", "_moved")

"""Exact duplicates by progressive refinement: length, then prefix hash, then the full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catloom.llm.common import SPACE, drop_rows, key_bitmap, mark_members, row_key, stored, text_of


def normalised(text: str) -> Column:
    """Runs of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    prefix: int = 128,
    filter_bits: int = 1 << 23,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the ``extra`` columns computed from the row.

    Texts are equal when their normalised forms are; of equal texts the row with the smallest id stays.
    Level 1 counts lengths, level 2 hashes of length and prefix among lengths that occur twice, level 3
    hashes whole texts of the groups still alive. Each level hands the next one a bitmap of its
    surviving keys (``filter_bits`` bits, a fixed size), so rows are dropped in the scan and no text is
    ever shuffled; a false hit of the bitmap only costs one more hash. The last level decides alone.

    Null and empty texts form one group. A null id is never chosen over a real one; rows without id
    whose group has no id have a null keep_id and stay. Rows that repeat both id and text share one
    fate: all of them are kept or dropped. An empty table gives an empty result.
    """
    base = docs.select(F.col(id).alias("_id"), normalised(text).alias("_norm"), *extra)
    extras = base.columns[2:]

    def survivors(df: DataFrame, key: str) -> DataFrame:
        return key_bitmap(df.groupBy(key).count().where("count > 1"), key, filter_bits)

    sized = base.select("*", F.octet_length("_norm").alias("_length"))
    lengths = stored(survivors(sized.select("_length"), "_length"))
    marked = mark_members(sized, "_length", lengths, filter_bits, "_same_length")
    key = F.xxhash64("_length", F.substring("_norm", 1, prefix))
    alive = marked.where("_same_length").select(key.alias("_prefix"))
    prefixes = stored(survivors(alive, "_prefix"))
    marked = mark_members(marked.withColumn("_prefix", key), "_prefix", prefixes, filter_bits, "_same_prefix")
    digest = F.when(F.col("_same_length") & F.col("_same_prefix"), F.sha2(F.col("_norm"), 256))
    rows = stored(marked.select("_id", digest.alias("_digest"), *extras))

    groups = rows.where("_digest is not null").groupBy("_digest").agg(
        F.min("_id").alias("_keep"), F.count("*").alias("_size")
    )
    # Written first: then both sides of the join are exchanged, and a hot group can be split at run time.
    groups = stored(groups.where("_size > 1").withColumnRenamed("_digest", "_g"))
    alone = rows.where("_digest is null").withColumn("_keep", F.col("_id")).withColumn("_size", F.lit(1).cast("long"))
    met = rows.where("_digest is not null").join(groups, F.col("_digest") == F.col("_g"), "left").drop("_g")
    met = met.withColumn("_keep", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")))
    met = met.withColumn("_size", F.coalesce("_size", F.lit(1).cast("long")))
    return alone.unionByName(met).select(
        F.col("_id").alias(id), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), *extras,
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; same columns.

    Rows are told apart by id and text: another text under the id of a dropped row stays, and so do rows without id. An
    empty table gives an empty one; texts of any length and columns of any name are left as they are.
    """
    marked = exact_dedup(docs, id, text, extra=[row_key(id, text)[1]])
    return drop_rows(docs, marked.where("not kept").select(F.col(id).cast("long").alias("_id"), "_h"), id, text)

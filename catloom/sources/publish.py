"""Read-models for browsing, as rows that a JSON sink writes in parallel.

A single document with every item in it would have to pass through one task. Each model is
therefore a table of bounded pieces: a meta row, and pages of items with their position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catloom.functions.text import slug
from catloom.operators.rank import paged_collect


def export_landing(items: DataFrame, order: Sequence[Column], fields: Sequence[str], generated_at: str, page_size: int = 1000) -> DataFrame:
    """Rows (part, page, body): one meta row, then pages with arrays of items; nulls are left out."""
    element = F.struct(*fields)
    one = items.withColumn("_all", F.lit(0))
    pages = paged_collect(one, ["_all"], order, element, page_size, "cameras").select(
        F.lit("cameras").alias("part"), "page", F.to_json(F.struct("cameras")).alias("body")
    )
    total = items.agg(F.count("*").alias("total")).select(
        F.lit("meta").alias("part"), F.lit(0).cast("long").alias("page"),
        F.to_json(F.struct("total", F.lit(generated_at).alias("generated_at"))).alias("body"),
    )
    return total.unionByName(pages)


def export_detail(items: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(id, body): one JSON document per item, without null fields."""
    return items.select(F.col(key).alias("id"), F.to_json(F.struct(*fields)).alias("body"))


def export_brands(items: DataFrame, brands: DataFrame, brand: str, order: Sequence[Column], fields: Sequence[str], page_size: int = 1000) -> DataFrame:
    """(region, brand, slug, page, brand columns, cameras): a brand's items in pages, newest brand data repeated.

    ``brands`` holds one row per brand with region, item_count and the other header columns.
    """
    pages = paged_collect(items, [brand], order, F.struct(*fields), page_size, "cameras")
    return brands.join(pages, brand).withColumn("slug", slug(brand))


def export_sitemap(base: str, brands: DataFrame, brand: str, details: DataFrame, key: str) -> DataFrame:
    """(url, change, priority) of the fixed, brand and item pages."""
    spark = brands.sparkSession
    fixed = spark.createDataFrame(
        [(base, "weekly", 1.0), (f"{base}/brands", "weekly", 0.9)], "url string, change string, priority double"
    )

    def pages(rows: DataFrame, kind: str, part: Column, priority: float) -> DataFrame:
        return rows.select(
            F.concat(F.lit(f"{base}/{kind}/"), part).alias("url"), F.lit("monthly").alias("change"), F.lit(priority).alias("priority")
        )

    return fixed.unionByName(pages(brands, "brands", slug(brand), 0.8)).unionByName(
        pages(details, "cameras", F.col(key).cast("string"), 0.7)
    )


def id_collisions(items: DataFrame, short: str, key: str) -> DataFrame:
    """Short ids that several items share; a keyed document store would overwrite all but one."""
    return items.groupBy(short).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).where("n > 1")

"""From source records to one catalog row per product."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from catloom.functions.rules import infer_format, is_excluded_tech, is_non_retail, normalize_format
from catloom.functions.text import normalize_name
from catloom.functions.values import compute_once
from catloom.operators import resolve
from catloom.operators.joins import fill_country, fill_launch_date, localized_name, make_key, normalize_alias
from catloom.operators.similarity import fuzzy_pairs
from catloom.vocabulary import FILM_MERGE_FIELDS, ITEM_MERGE_FIELDS
from catloom.runtime import cut_lineage


@dataclass
class Resolved:
    records: DataFrame   # input with keys and final cluster
    merged: DataFrame    # one row per cluster
    images: DataFrame    # cluster, first_seq, first_pos, element
    sources: DataFrame
    review: DataFrame    # similar pairs left to a person


def prepare(records: DataFrame, aliases: DataFrame, brand: str = "manufacturer", name: str = "name") -> DataFrame:
    """Canonical brand, comparison name and key."""
    keyed = normalize_alias(records, brand, aliases, "manufacturer_normalized")
    keyed = keyed.withColumn("block", F.lower(F.coalesce("manufacturer_normalized", F.lit(""))))
    keyed = keyed.withColumn("match_name", normalize_name(name))
    return keyed.withColumn("key", make_key("manufacturer_normalized", name))


def resolve_records(
    records: DataFrame, aliases: DataFrame, fields: Sequence[str], lo: int = 80, hi: int = 90, stats: resolve.MergeStats | None = None,
) -> Resolved:
    """Exact links, similar names, best value per field, merged images and sources; ``stats`` counts along the way."""
    keyed = prepare(records, aliases)
    linked = resolve.connect(keyed, "key", "wikidata_qid", "seq", leaders_too=stats is not None)
    if stats is not None:
        linked = stats.inputs(linked, "seq", "id_leader", "key_leader").drop("id_leader", "key_leader")
    linked = cut_lineage(linked)
    # One representative per cluster enters the similarity step: its first record.
    heads = linked.groupBy("cluster").agg(F.min_by(F.struct("block", "match_name"), "seq").alias("h")).select("cluster", "h.*")
    pairs = fuzzy_pairs(heads, "block", "match_name", "cluster", lo)
    pairs = cut_lineage(pairs if stats is None else stats.pairs(pairs, lo, hi))
    stars = resolve.fuzzy_cluster(resolve.merge_ready(pairs, hi))
    stars = stars if stats is None else cut_lineage(stats.stars(stars))
    final = resolve.absorb(linked, stars, "cluster")
    ids = [c for c in ("wikidata_qid", "flickr_id") if c in records.columns]
    base = [c for c in ("name", "manufacturer", "manufacturer_normalized", "price_launch_currency", "price_launch_source", "price_market_source") if c in final.columns]
    merged = resolve.survivorship(final, "cluster", "seq", [*fields, *ids], [*base, "key"])
    merged = merged if stats is None else stats.merged(merged)
    return Resolved(
        records=final,
        merged=merged,
        images=resolve.union_values(final, "cluster", "seq", "images", ["url"]),
        sources=resolve.union_values(final, "cluster", "seq", "sources", ["source", "source_id"], last_in_base=False),
        review=resolve.review_queue(pairs, lo, hi),
    )


def finish_items(merged: DataFrame, prefixes: DataFrame, countries: DataFrame, stats: resolve.MergeStats | None = None) -> DataFrame:
    """Id, Latin name, launch date, country and format; then the two exclusion filters."""
    named = localized_name(merged.withColumn("id", resolve.cluster_id("key")), "name", "manufacturer_normalized", prefixes, "cluster")
    dated = named.withColumn("launch_date", fill_launch_date("launch_date", "year_introduced"))
    placed = fill_country(dated, "manufacturer_normalized", "manufacturer_country", countries)
    # Names and countries are settled here, so the rules below read plain columns.
    settled = compute_once(placed, name=F.col("name"), manufacturer_country=F.col("manufacturer_country"))
    non_retail = is_non_retail("name", "description", "manufacturer_normalized")
    excluded = is_excluded_tech("name", "camera_type", "manufacturer_normalized")
    if stats is None:
        kept = settled.where(~non_retail).where(~excluded)
    else:
        flagged = compute_once(settled, _non_retail=non_retail, _excluded=excluded)
        kept = stats.filtered(flagged, "_non_retail", "_excluded").where("not _non_retail and not _excluded").drop("_non_retail", "_excluded")
    fmt = F.coalesce(normalize_format("film_format"), infer_format("name", "camera_type", "manufacturer_normalized"))
    return kept.withColumn("film_format", fmt)


def merge_items(
    records: DataFrame, aliases: DataFrame, prefixes: DataFrame, countries: DataFrame, stats: resolve.MergeStats | None = None,
) -> tuple[DataFrame, Resolved]:
    """Catalog rows and what they come from. ``stats`` is complete once the rows were computed."""
    resolved = resolve_records(records, aliases, ITEM_MERGE_FIELDS, stats=stats)
    return finish_items(resolved.merged, prefixes, countries, stats), resolved


def merge_films(records: DataFrame, aliases: DataFrame) -> tuple[DataFrame, Resolved]:
    """Same engine with the film fields and no exclusions."""
    resolved = resolve_records(records, aliases, FILM_MERGE_FIELDS)
    films = resolved.merged.withColumn("id", resolve.cluster_id("key"))
    return films.withColumn("launch_date", fill_launch_date("launch_date", "year_introduced")), resolved

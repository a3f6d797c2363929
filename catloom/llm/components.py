"""Connected components of an undirected edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges``, stored; root is the smallest node of its component.

    Alternating large-star and small-star steps. Each step takes the minimum per node with partial
    aggregation and sends it to the neighbours by a join, so a hub's neighbours never meet in one
    group. ``rows`` is the number of edges, if known. Rounds grow with the logarithm of the longest path; every round is written and re-read.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    for _ in range(max_rounds):
        count, settled = _state(links)
        if settled:
            break
        links = _small_star(_large_star(links, count), count)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stored(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), 2 * count)
    discard(links)
    return out


def _state(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether all are stars: no node has two smaller ones, or one and a larger one. Steps leave stars as they are."""
    ends = links.select(F.col("u").alias("k"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("k"), F.lit(0).alias("up")))
    nodes = ends.groupBy("k").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    count, bad = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if(F.expr("ups > 1 or (ups > 0 and least = 0)"))).first()
    return count, bad == 0


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's minimum. Takes the place of ``links``."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first: then both sides of the join are exchanged, and the neighbours of a hub can be split at run time.
    low = stored(_minimum(both), 2 * rows)
    met = both.where("v > u").join(low, F.col("u") == F.col("k"))
    out = stored(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), 2 * rows)
    discard(links, low)
    return out


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the node's minimum. Takes the place of ``links``."""
    low = stored(_minimum(links), rows)  # read twice
    met = links.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(F.col("k").alias("u"), F.col("m").alias("v"))
    out = stored(met.unionByName(own).where("u <> v").distinct(), 2 * rows)
    discard(links, low)
    return out

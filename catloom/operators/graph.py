"""Category trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catloom.runtime import cut_lineage


def walk_tree(edges: DataFrame, roots: DataFrame, max_depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, depth) reachable from the roots in at most ``max_depth`` steps, at least depth, cycles safe.

    Breadth first: each level is the frontier joined with the edges, minus what was seen before.
    Edges and levels are checkpointed: edges are derived once, and the plan does not grow with the depth.
    """
    edges = cut_lineage(edges.select(parent, child))
    seen = cut_lineage(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier["node"] == edges[parent]).select(F.col(child).alias("node")).distinct()
        fresh = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen

"""Connected components of an edge table, by alternating large-star and small-star steps in Spark.

Each step is one aggregate (the least neighbour of each node, combined before the shuffle) and one
join; rounds are written to the shared folder, so no lineage grows and lost executors cost a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 31)), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, component): the least node reachable, for each node in an edge."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        # large star: every greater neighbour of a node is linked with the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked with the least of them
        large = stored(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now, before = stored(small), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(components: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components (as above, or None) with more edges between their nodes or new ones. Only the edges
    between components are followed, so that a step costs what it adds."""
    if components is None:
        return connected_components(edges)
    of = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    more = connected_components(between)
    moved = components.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = more.join(components.select("node"), "node", "left_anti")  # a component bears the name of one of its nodes
    return stored(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), "components")

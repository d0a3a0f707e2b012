"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.common import drop, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that an edge (u, v) names.

    Alternates large-star and small-star steps: every edge moves to the least neighbour until
    each component is a star. Sums per node combine before the shuffle; a node with very many
    edges meets a join whose partitions can be split. Each round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most. Self-loops, nulls
    and repeated edges are dropped; nodes without another edge are not returned.
    """
    stars = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if now == before or not now[0]:
            break
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # After the large step every edge points down (u > v), so the small step's neighbours are those given.
        linked = _with_least(large)
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(linked.select("u", F.col("m").alias("v"))).distinct()
        old, stars = stars, written(small)
        drop(old)
    # Every component is a star around its least node now.
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

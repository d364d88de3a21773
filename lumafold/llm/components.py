"""Connected components by hooking and contraction; nothing is collected but a row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import drop_staged, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: for every node of ``edges`` (a, b: long) the smallest node of its component.

    In each round a node takes its smallest neighbour for its parent if that is smaller than itself. A local minimum
    that no node took has no child, so it takes its smallest neighbour without closing a cycle. Every node is now in a
    tree of two nodes or more, so when trees are contracted to their roots (by pointer jumping, in log depth steps) at
    least half of the nodes go: n nodes need at most log2 n rounds, whatever the diameter and the numbers of the nodes.
    The bound ``max_rounds`` is beyond any table; if it is ever hit, an error is raised. Every step is a written table.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    levels: list[DataFrame] = []
    while not levels or both.limit(1).count():
        if len(levels) == max_rounds:
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
        levels.append(_trees(both, len(levels)))
        ends = levels[-1]
        met = both.join(ends.withColumnsRenamed({"node": "a", "up": "top_a"}), "a").join(ends.withColumnsRenamed({"node": "b", "up": "top_b"}), "b")
        rest = stage(met.where("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), f"cc-edges-{len(levels)}")
        drop_staged(both)
        both = rest
    tops = levels[-1]
    for level in reversed(levels[:-1]):
        above = tops.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = level.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    lowest = tops.groupBy("up").agg(F.min("node").alias("root"))
    roots = stage(tops.join(lowest, "up").select("node", "root"), "cc")
    drop_staged(both, *levels)
    return roots


def _trees(both: DataFrame, level: int) -> DataFrame:
    """node, up: the root of each node's tree after one round of hooking over ``both`` (each edge in both directions)."""
    low = stage(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), "near", F.least("a", "near").alias("up")), f"cc-low-{level}")
    taken = low.where("up <> node").select(F.col("up").alias("node")).distinct().withColumn("taken", F.lit(True))
    alone = (F.col("up") == F.col("node")) & F.col("taken").isNull()
    trees = stage(low.join(taken, "node", "left").select("node", F.when(alone, F.col("near")).otherwise(F.col("up")).alias("up")), f"cc-{level}")
    drop_staged(low)
    moved = 1
    while moved:
        above = trees.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = stage(trees.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"cc-jump-{level}")
        drop_staged(trees)
        trees, moved = jumped.select("node", "up"), jumped.where("moved").limit(1).count()
        trees._lumafold_path = jumped._lumafold_path
    return trees

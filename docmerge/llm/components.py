"""Distributed connected components by contraction.

Every node hooks to its smallest neighbour, chains of hooks are shortened by pointer jumping, and edges are contracted to the
roots until none is left. Minima are summed per task before the shuffle; the joins bring unique labels to
edges, so a node may hold any share of the edges (AQE splits such a join). Every step is stored with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.session import checkpointed


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) of the forest in which every node hooks to its smallest neighbour, if that is smaller."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(hooks.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: not null, of one type); component: the smallest node reachable.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = checkpointed(edges.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while found is None or not edges.isEmpty():
        roots = _roots(edges)
        if found is None:
            found = roots.select("node", F.col("root").alias("component"))
        else:
            moved = roots.select(F.col("node").alias("component"), "root")
            found = checkpointed(found.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        edges = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        edges = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
        edges = checkpointed(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return found

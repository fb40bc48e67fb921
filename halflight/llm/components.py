"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflight.session import cut_lineage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: every node of ``links`` with the root of its component.

    Each round gives the nodes a new hashed order. A node hooks onto its first neighbour in that order
    and then onto that one's hook; linked nodes with different hooks remain as the links of the next
    round. In a hashed order chains of hooks are short however the nodes are numbered, so that each
    round leaves a fraction of the nodes and the number of rounds is logarithmic. Rounds hold
    (node, root) and (root, root) pairs only; minima are taken before rows move, and every round's
    tables are checkpointed.
    """
    edges = cut_lineage(links.select(F.col(a).alias("x"), F.col(b).alias("y"))
                        .filter("x <> y").distinct())
    roots, number = None, 0
    while not edges.isEmpty():
        number += 1
        order = lambda c, n=number: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = cut_lineage(both.groupBy("x").agg(F.min(order("y")).alias("y")).select(
            F.col("x").alias("node"), F.least(order("x"), F.col("y"))["node"].alias("hook")))
        further = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("root"))
        hooks = cut_lineage(hooks.join(further, "hook").select("node", "root"))
        if roots is None:
            roots = hooks
        else:
            moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut_lineage(roots.join(moved, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")))
        at_x = hooks.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        at_y = hooks.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = cut_lineage(edges.join(at_x, "x").join(at_y, "y").filter("rx <> ry").select(
            F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
    if roots is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots

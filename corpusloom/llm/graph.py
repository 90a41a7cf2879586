"""Connected components of an edge table, in DataFrame steps over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, label): the least node of each node's component.

    Each round points every node at its least neighbour below it, follows the pointers to their roots by doubling, and puts
    the roots in place of the nodes in the edges; edges within a root vanish. At least half of the nodes that still have an
    edge become part of another, so the edges shrink and few rounds are needed. Only emptiness comes to the driver."""

    def ordered(e: DataFrame) -> DataFrame:
        return materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    e = ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    member = e.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    while not e.isEmpty():
        up = materialize(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "pointers")
        while True:
            over = up.select(F.col("node").alias("o_node"), F.col("label").alias("o_label"))
            step = up.join(over, F.col("label") == F.col("o_node"), "left")
            up = materialize(step.select("node", F.coalesce("o_label", "label").alias("label"), F.col("o_node").isNotNull().alias("moved")), "pointers")
            moved = not up.filter("moved").isEmpty()
            up = up.select("node", "label")
            if not moved:
                break
        to_a, to_b = (up.select(F.col("node").alias(f"{s}_node"), F.col("label").alias(f"{s}_label")) for s in ("x", "y"))
        moved_on = member.join(to_a, F.col("label") == F.col("x_node"), "left").select("node", F.coalesce("x_label", "label").alias("label"))
        member = materialize(moved_on.unionByName(up), "members")
        e = e.join(to_a, F.col("a") == F.col("x_node"), "left").join(to_b, F.col("b") == F.col("y_node"), "left")
        e = ordered(e.select(F.coalesce("x_label", "a").alias("a"), F.coalesce("y_label", "b").alias("b")))
    return member.unionByName(member.select(F.col("label").alias("node"), "label").distinct())

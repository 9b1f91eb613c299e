"""Connected components of an edge table, by alternating large-star and small-star steps.

Only minima per node travel, folded before each shuffle; a hub's edges are joined with its one
minimum, a join that Spark splits when it is skewed. No component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm.shared import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Rows (node, root) for every node with an edge; the root is the least node of its component.

    `edges` has columns a and b of one orderable type, in any direction; loops, repeated edges and
    edges with a null end are no links. Each round stores its edges; the last one leaves stars.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    edges = tables.stored(ends.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    while not is_starry(edges):
        # Large star: every greater neighbour of a node is linked to the least node around it.
        both = edges.union(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        near = both.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least"))
        near = near.select("node", F.least("node", "least").alias("least"))
        large = (
            edges.join(near, edges["parent"] == near["node"])
            .select("child", F.col("least").alias("parent"))
            .distinct()
        )
        # Small star: a node's lesser neighbours and itself are linked to the least of them.
        lesser = large.groupBy("child").agg(F.min("parent").alias("least")).withColumnRenamed("child", "node")
        linked = large.join(lesser, large["child"] == lesser["node"])
        small = linked.select(F.col("parent").alias("child"), F.col("least").alias("parent")).union(
            lesser.select(F.col("node").alias("child"), F.col("least").alias("parent"))
        )
        after = tables.stored(small.filter("child <> parent").distinct())
        tables.drop(edges)
        edges = after
    roots = edges.select("parent").distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(
        roots.select(F.col("parent").alias("node"), F.col("parent").alias("root"))
    )


def is_starry(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child: the components are found."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counts.filter("up > 1 or (up > 0 and down > 0)").take(1)

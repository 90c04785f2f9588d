"""Connected components of edges in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import cut


#: Small tables go on in few tasks and files.
EDGES_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of the nodes of edges (a, b).

    In each round a node takes the least root of its neighbours, and then the root of that root, so that
    the rounds grow with the logarithm of the longest path rather than with the path.
    """
    links = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    parts = max(1, -(-links.count() // EDGES_A_TASK))
    roots = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")).coalesce(parts))
    while True:
        offered = links.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offered"))
        better = roots.join(offered, "node").select("node", "root", F.least("root", "offered").alias("next"))
        through = better.join(roots.select(F.col("node").alias("next"), F.col("root").alias("beyond")), "next", "left")
        moved = cut(through.select("node", "root", F.least("next", F.coalesce("beyond", "next")).alias("next")).coalesce(parts))
        if moved.where("next <> root").isEmpty():
            return roots
        roots = moved.select("node", F.col("next").alias("root"))

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours (large: the larger ones; else the smaller ones and itself) to the smallest of all."""
    pairs = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join's two sides are plain shuffles, of which Spark splits what a hub makes large
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    tied = pairs.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) for all nodes of `edges` (u, v; long): root is the component's smallest node. Each step is written
    to the shared folder; their number is logarithmic, and if `most` steps aren't enough that is an error. Self-loops and repeated
    edges do no harm."""
    edges = written(edges.filter("u <> v").distinct())
    for _ in range(most):
        # done when every node is tied to one root, and no root is tied to another
        n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
        if n["n"] == n["u"] and edges.join(edges.select(F.col("v").alias("w")), F.col("u") == F.col("w"), "left_semi").isEmpty() and edges.filter("u < v").isEmpty():
            break
        edges = written(_star(_star(edges, True), False))
    else:
        raise RuntimeError(f"components aren't found in {most} steps")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)

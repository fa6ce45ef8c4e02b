"""Sums over the subtrees of a forest, by parallel tree contraction.

A round rakes all leaves (their sums are known, and go to their parents) and compresses unary chains: of the nodes with one
child, those whose seeded hash is larger than that of such neighbours in the chain are spliced out, about a third of
them. So the number of rounds is logarithmic, whatever the shape: a chain of a million nodes or a node with a million
children. Then the rounds are undone, last first: a spliced node's sum is what it held, and its child's sum.

All joins are on unique ids. What many children tell one parent is added up before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import written


def subtree_sums(nodes: DataFrame, values: list[str], node: str = "id", parent: str = "parent", most: int = 200) -> DataFrame:
    """(node, values): for each node of `nodes` (node, parent, values), the sums over it and all below it.

    Ids are unique and may be of any type that can be ordered; a null parent makes a root. Null values count as 0. Other columns
    are left out; an empty table gives an empty one. A parent that isn't a node, or a circle, is an error once no round makes progress."""
    kept = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    vs = [f"v{i}" for i in range(len(values))]
    plus = lambda v: (F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0))).alias(v)
    sums = [F.sum(v).alias(f"more_{v}") for v in vs]
    kids = kept.filter("up is not null").groupBy(F.col("up").alias("of")).agg(F.count("*").alias("kids"))
    active = written(kept.join(kids, F.col("id") == F.col("of"), "left").select("id", "up", F.coalesce("kids", F.lit(0)).alias("kids"), *vs))
    rounds, left = [], active.count()
    while left:
        if len(rounds) == most:
            raise RuntimeError(f"{left} nodes are left after {most} rounds")
        # rake
        leaves = active.filter("kids = 0")
        told = leaves.filter("up is not null").groupBy(F.col("up").alias("of")).agg(F.count("*").alias("gone"), *sums)
        raked = active.filter("kids > 0").join(told, F.col("id") == F.col("of"), "left")
        raked = written(raked.select("id", "up", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *[plus(v) for v in vs]))
        # compress
        only = raked.filter("up is not null").groupBy(F.col("up").alias("of")).agg(F.min("id").alias("child"))
        unary = raked.filter("kids = 1 and up is not null").join(only, F.col("id") == F.col("of")).withColumn("h", F.xxhash64("id", F.lit(len(rounds))))
        unary = written(unary.select("id", "up", "child", "h", *vs))
        below = unary.select(F.col("id").alias("b_id"), F.col("h").alias("b_h"))
        lost = unary.join(below, F.col("child") == F.col("b_id")).select(F.when(F.col("h") > F.col("b_h"), F.col("b_id")).otherwise(F.col("id")).alias("id"))
        spliced = written(unary.join(lost.distinct(), "id", "left_anti").select("id", "up", "child", *vs))
        raised = spliced.select(F.col("child").alias("of_child"), F.col("up").alias("new_up"))
        told = spliced.groupBy(F.col("up").alias("of")).agg(*sums)
        stay = raked.join(spliced.select("id"), "id", "left_anti").join(raised, F.col("id") == F.col("of_child"), "left").join(told, F.col("id") == F.col("of"), "left")
        rounds.append((leaves.select("id", *vs), spliced))
        active = written(stay.select("id", F.coalesce("new_up", "up").alias("up"), "kids", *[plus(v) for v in vs]))
        left = active.count()
    known = kept.select("id", *vs).limit(0)
    for leaves, spliced in reversed(rounds):  # what later rounds knew holds every child of this one's spliced nodes
        below = known.select(F.col("id").alias("b_id"), *[F.col(v).alias(f"more_{v}") for v in vs])
        found = written(spliced.join(below, F.col("child") == F.col("b_id")).select("id", *[plus(v) for v in vs]))
        known = known.unionAll(leaves).unionAll(found)
    return known.select(F.col("id").alias(node), *[F.col(x).alias(v) for x, v in zip(vs, values, strict=True)])

"""Connected components by aggregation and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.durable import materialize


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``: then each v is its component's least node."""
    one, none = F.lit(1), F.lit(0)
    ends = pairs.select(F.col("u").alias("x"), one.alias("up"), none.alias("down")).unionByName(pairs.select(F.col("v").alias("x"), none.alias("up"), one.alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round only
    aggregates and joins, so no component meets in one task; the number of rounds grows
    with the logarithm of the graph. Each round is a durable table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "cc")
    for _ in range(max_rounds):
        if _is_star_forest(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = materialize(small.where("u <> v").distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

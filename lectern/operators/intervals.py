"""Joins of intervals by bins of their own size, without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column, width: float) -> Column:
    """The least level whose bins, ``width * 2 ** level`` long, are at least as long as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((high - low) / width, F.lit(1.0))))).cast("int")


def interval_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs ``(a, b)`` of rows (structs) of ``left`` and ``right``, both with ``low`` and ``high``, whose closed intervals meet; each pair once.

    An interval lies in two bins at most of its own level, where bins are as long as itself, and so at all
    higher ones. Two intervals meet at the higher of their levels: each side enters its bins at its
    own level and at those that the other side has above it, so neither long nor short ones multiply. Rows with a
    null or a low above the high take no part.
    """

    def leveled(df: DataFrame, name: str) -> DataFrame:
        some = df.where((F.col("low") <= F.col("high")) & F.col("low").isNotNull() & F.col("high").isNotNull())
        return some.select(F.struct(*df.columns).alias(name), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), _level(F.col("low"), F.col("high"), width).alias("own"))

    a, b = leveled(left, "a"), leveled(right, "b")
    levels = lambda df: sorted(r[0] for r in df.select("own").distinct().collect())  # noqa: E731 - a few dozen at most
    on_a, on_b = levels(a), levels(b)

    def binned(df: DataFrame, others: list[int], name: str) -> DataFrame:
        at = F.array_distinct(F.concat(F.array("own"), F.filter(F.lit(others) if others else F.array().cast("array<int>"), lambda x: x > F.col("own"))))
        each = df.select(name, "low", "high", "own", F.explode(at).alias("level")).withColumn("size", F.lit(width) * F.pow(F.lit(2.0), F.col("level")))
        first, last = F.floor(F.col("low") / F.col("size")), F.floor(F.col("high") / F.col("size"))
        return each.select(name, F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"), F.col("own").alias(f"{name}_own"), "level", F.explode(F.sequence(first, last)).alias("bin"), first.alias(f"{name}_first"))

    met = binned(a, on_b, "a").join(binned(b, on_a, "b"), ["level", "bin"])
    once = (F.col("level") == F.greatest("a_own", "b_own")) & (F.col("bin") == F.greatest("a_first", "b_first"))
    return met.where(once & (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).select("a", "b")

"""Composition of one attribute within the levels of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_counts(df: DataFrame, within: str, of: str, weight: str | None = None) -> DataFrame:
    """Rows (or the sum of their weights) per pair of levels, null levels included."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(within, of).agg(n.alias("n"))


def category_shares(counts: DataFrame, within: str) -> DataFrame:
    """Share of each count in the total of its ``within`` level.

    The window runs over counts, one row per pair of levels, not over episodes.
    """
    total = F.sum("n").over(Window.partitionBy(within))
    return counts.withColumn("prop", F.col("n") / total)

"""Connected components of links that no single machine can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import fixed


def _checksum(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total).first())


def _with_least(links: DataFrame, own: bool) -> DataFrame:
    """Every link (a, b) beside the smallest neighbour ``m`` of a (``own``: or a itself).

    The minima are written first. Both sides of the join are then plain shuffles, which adaptive execution splits where
    one node has very many links.
    """
    least = F.min("b")
    least = links.groupBy("a").agg((F.least(least, "a") if own else least).alias("m"))
    return links.join(fixed(least), "a")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for every node of ``links``; the component is the smallest node reachable.

    Alternates two steps until nothing changes: each node ties its larger neighbours, then its smaller ones, to the
    smallest node it knows. Rounds grow with the logarithm of the nodes; every round is written to a table.
    Links to itself and links with a null end count for nothing; repeated links count once. No links: no rows.
    """
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    now = fixed(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _checksum(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, own=True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = fixed(large.distinct())
        small = _with_least(large, own=False)
        rest = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = fixed(small.select("a", F.col("m").alias("b")).unionByName(rest).distinct())
        before, state = state, _checksum(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

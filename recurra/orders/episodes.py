"""A customer is an entity; each order line is an episode from order date to ship date."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.operators.attributes import consistent_attribute
from recurra.operators.clean import valid_episodes
from recurra.plans.reports import ReturnStudy
from recurra.spec import CohortWindow, EpisodeSpec

SPEC = EpisodeSpec(
    entity="custkey",
    start="order_date",
    end="ship_date",
    attributes=("priority", "segment"),
    entity_nullable=False,
)
# The same where the segment is left to be joined later.
UNSEGMENTED = replace(SPEC, attributes=("priority",))
YEAR = 1996
# The cohort year in which index episodes reach every duration band.
DURATION_YEAR = 1998
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """The priority "4-NOT SPECIFIED" stands for a missing one."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        F.to_date("o_orderdate").alias("order_date"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(F.col("l_orderkey").alias("orderkey"), F.to_date("l_shipdate").alias("ship_date"))


def order_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """All episodes, without the segment.

    Both joins here are between tables as they are scanned, so adaptive execution sees the sizes of their partitions
    and splits those of a heavy order or customer by itself.
    """
    episodes = _orders(spark, folder).join(_lines(spark, folder), "orderkey")
    return episodes.select("custkey", "order_date", "ship_date", "priority")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segment of every customer, an attribute of entities."""
    customers = table(spark, folder, "customer")
    return customers.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))


def segmented_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """All episodes with the customer's segment in every row, for row-level results that show it."""
    orders = _orders(spark, folder).join(segments(spark, folder), "custkey", "left")
    return orders.join(_lines(spark, folder), "orderkey").select(*SPEC.columns)


def status_records(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """An attribute that is recorded with every order and may conflict: what the customer's balance says, missing below
    zero, but WATCH where an urgent order is large. ``more`` names columns of the order to be kept.
    """
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    balance = F.when(F.col("c_acctbal") >= 5000, "HIGH").when(F.col("c_acctbal") >= 0, "LOW")
    large = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400_000)
    status = F.when(large, "WATCH").otherwise(balance)
    joined = orders.join(customers, "o_custkey", "left")
    return joined.select(F.col("o_custkey").alias("custkey"), status.alias("status"), *more)


def clean_status(spark: SparkSession, folder: str) -> DataFrame:
    return consistent_attribute(status_records(spark, folder), "custkey", "status")


def study(
    spark: SparkSession, folder: str, year: int = YEAR, segment: bool = False, status: bool = False
) -> ReturnStudy:
    attributes = {"status": clean_status(spark, folder)} if status else {}
    if segment:
        attributes["segment"] = segments(spark, folder)
    episodes = valid_episodes(order_episodes(spark, folder), SPEC)
    return ReturnStudy(episodes, SPEC, CohortWindow.of_year(year), entity_attributes=attributes)

"""Every query on tables in which one customer, one order and one copied line hold a third of the rows each."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recurra.orders.episodes import order_episodes, segmented_episodes
from recurra.orders.queries import QUERIES
from recurra.orders.sql import ORACLE
from tests.comparison import assert_same, sql_connection

SOURCE = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")

    def save(df, name):
        df.repartition(8).write.parquet(f"{folder}/{name}.parquet")

    orders = spark.read.parquet(f"{SOURCE}/orders.parquet")
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet")
    hot = orders.where("year(o_orderdate) = 1996").agg(F.min("o_orderkey")).first()[0]
    custkey = orders.where(F.col("o_orderkey") == hot).first()["o_custkey"]
    third = F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == 0
    save(orders.withColumn("o_custkey", F.when(third & (F.year("o_orderdate") >= 1996), custkey).otherwise(F.col("o_custkey"))), "orders")
    one_order = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 1
    moved = lines.withColumn("l_orderkey", F.when(one_order, hot).otherwise(F.col("l_orderkey")))
    copied = lines.where(F.col("l_orderkey") == hot).limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1500))))
    save(moved.unionByName(copied.drop("n")), "lineitem")
    for name in ("customer", "documents"):
        save(spark.read.parquet(f"{SOURCE}/{name}.parquet"), name)
    return str(folder)


def test_tables_are_skewed(spark, skewed):
    episodes = order_episodes(spark, skewed)
    total = episodes.count()
    per_customer = episodes.groupBy("custkey").count().orderBy(F.desc("count")).first()
    per_row = episodes.groupBy(*episodes.columns).count().orderBy(F.desc("count")).first()
    assert per_customer["count"] > total / 3 and per_row["count"] >= 1500


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, skewed, name):
    with sql_connection(skewed) as con:
        assert_same(QUERIES[name](spark, skewed), con, ORACLE[name])


ROW_LEVEL = ["cohort_episodes", "prepared_cohort", "classified_episodes", "case_ids"]


@pytest.mark.parametrize("build", [order_episodes, segmented_episodes, *[QUERIES[n] for n in ROW_LEVEL]])
def test_adaptive_execution_splits_heavy_keys(spark, skewed, build):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "1k",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = build(spark, skewed)
        df.collect()
        assert "isSkewJoin=true" in df._jdf.queryExecution().executedPlan().toString() or "skew=true" in (
            df._jdf.queryExecution().executedPlan().toString()
        )
    finally:
        for k in settings:
            spark.conf.unset(k)

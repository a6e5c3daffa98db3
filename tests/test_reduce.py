"""The filter by keys that goes before a join: what it keeps, how full it may be, and where it ends up in a plan."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recurra import cohort_episodes, valid_episodes, with_keys_of
from recurra.operators.cohort import index_starts
from recurra.operators.reduce import MOST_WORDS, filter_words, key_filter
from recurra.orders.episodes import SPEC, order_episodes
from recurra.orders.queries import QUERIES, WINDOW

ORDERS = "/root/testdata/sf0.01"


def test_no_row_with_a_partner_is_lost_and_few_others_stay(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 == 7, None).otherwise(F.col("id")).alias("k"), "id")
    facts = spark.range(3000).select((F.col("id") * 50).alias("k"))
    with_null = facts.unionByName(spark.createDataFrame([(None,)], "k bigint"))
    kept = with_keys_of(rows, facts, ["k"])
    assert kept.join(facts, "k").count() == rows.join(facts, "k").count() == 3000
    assert kept.count() < 3000 + 200_000 * 0.02
    assert kept.where("k is null").count() == 0
    assert with_keys_of(rows, with_null, ["k"]).where("k is null").count() == 200


def test_keys_of_several_columns(spark):
    rows = spark.range(5000).select((F.col("id") % 70).alias("a"), F.concat(F.lit("k"), F.col("id") % 13).alias("b c"))
    facts = rows.where("a = 3").distinct()
    kept = with_keys_of(rows, facts, ["a", "b c"])
    assert kept.where("a = 3").count() == rows.where("a = 3").count() and kept.count() < 400


def test_no_keys_leave_no_rows(spark):
    assert with_keys_of(spark.range(100), spark.range(0), ["id"]).count() == 0


def test_size_of_the_filter():
    assert filter_words(0) == 1
    assert filter_words(1000) == 256
    assert filter_words(MOST_WORDS * 6) == MOST_WORDS
    assert filter_words(MOST_WORDS * 9) == 0


def test_too_many_keys_leave_the_rows_as_they_are(spark):
    rows, facts = spark.range(1000), spark.range(500)
    assert with_keys_of(rows, facts, ["id"], most_words=32) is rows
    assert with_keys_of(rows, facts, ["id"], most_words=64).count() >= 500


def test_the_filter_is_one_row_of_bounded_size(spark):
    words = key_filter(spark.range(100_000), ["id"], 512).collect()
    assert len(words) == 1 and len(words[0]["bits"]) == 512


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
def test_episodes_outside_the_cohort_are_not_shuffled(spark):
    """The rows left of the whole table are nearly those of the cohort, and they are left out at the scan of orders."""
    episodes = valid_episodes(order_episodes(spark, ORDERS), SPEC)
    joined = cohort_episodes(episodes, SPEC, WINDOW).count()
    facts = index_starts(episodes, SPEC, WINDOW)
    assert joined < episodes.count() / 2
    assert with_keys_of(episodes, facts, ["custkey"]).count() < joined * 1.1


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["cohort_episodes", "classified_episodes", "monthly_cohort_episodes", "prepared_cohort"])
def test_the_filter_reaches_the_scan_of_orders(spark, name):
    lines = QUERIES[name](spark, ORDERS)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Filter" in line and "xxhash64(o_custkey" in line]
    # The filter stands below the projection of the scan, under every join.
    assert at and all("Project [o_orderkey" in lines[i - 1] for i in at)

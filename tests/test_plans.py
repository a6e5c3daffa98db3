"""Shape of the physical plans: what is scanned, what is shuffled, what never appears."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path

import pytest

from recurra import CohortWindow, EpisodeSpec, ReturnStudy, build_cohort, cohort_episodes, consistent_attribute, valid_episodes
from recurra.orders.queries import QUERIES
from tests import brute_force as bf

SPEC = EpisodeSpec(entity_nullable=False)
WINDOW = CohortWindow.of_year(2010)


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    spark.createDataFrame([(1, date(2009, 1, 1), date(2010, 1, 1), "Drug", "A")], bf.SCHEMA).write.parquet(f"{folder}/e")
    spark.createDataFrame([(1, "High")], "pers_id bigint, risk string").write.parquet(f"{folder}/r")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    episodes = valid_episodes(spark.read.parquet(f"{folder}/e"), SPEC)
    risk = consistent_attribute(spark.read.parquet(f"{folder}/r"), "pers_id", "risk")
    yield ReturnStudy(episodes, SPEC, WINDOW, entity_attributes={"risk": risk})
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


REPORTS = {
    "overall": lambda s: s.rates(),
    "by_crime": lambda s: s.rates("crime_type"),
    "by_risk": lambda s: s.rates("risk"),
    "by_duration": lambda s: s.rates_by_duration(),
    "by_each": lambda s: s.rates_by_each("crime_type", "ed_level", "risk"),
    "mix": lambda s: s.mix("risk", "crime_type"),
    "cohort": lambda s: build_cohort(s.episodes, SPEC, WINDOW),
    "cohort_episodes": lambda s: cohort_episodes(s.episodes, SPEC, WINDOW, ties="weighted"),
}
EPISODE_SCAN = r"FileScan parquet \[[^\]]*[\[,]sentence_date"


def outside_subqueries(text: str) -> str:
    """The plan without those of the values that its conditions use."""
    kept, inside = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if line.lstrip(" :+-").startswith("Subquery") else None
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("name", REPORTS)
def test_no_pair_joins_and_no_single_partition(study, name):
    text = outside_subqueries(plan(REPORTS[name](study)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # Only the one-row total may meet in a single partition, after partial aggregation.
    allowed = 1 if name == "overall" else 0
    assert text.count("SinglePartition") == allowed
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", [n for n in REPORTS if n != "cohort_episodes"])
def test_reports_scan_the_episodes_once(study, name):
    report = REPORTS[name](study)
    report.collect()
    text = plan(report).split("== Initial Plan ==")[0]
    assert len(re.findall(EPISODE_SCAN, text)) == 1
    # Days meet first ends if attributes come in, and entities meet their attributes.
    joins = {"by_risk": 1, "by_crime": 1, "by_each": 2, "mix": 2}
    assert plan(REPORTS[name](study)).count("SortMergeJoin") == joins.get(name, 0)


def test_grouping_by_day_comes_before_the_entity_meets(study):
    lines = [line for line in plan(study.rates()).splitlines() if "Exchange hashpartitioning" in line]
    assert len(lines) == 2
    assert re.search(r"hashpartitioning\(pers_id#\d+L, \d+\)", lines[0])
    assert re.search(r"hashpartitioning\(pers_id#\d+L, sentence_date#\d+, \d+\)", lines[1])


def test_entity_attributes_join_without_moving_the_cohort_again(study):
    """Two shuffles of episodes, two of attribute records (pairs, then keys), one of the report."""
    assert plan(study.rates("risk")).count("Exchange hashpartitioning") == 5


def test_columns_are_pruned_and_filters_reach_the_scan(study):
    scan = next(line for line in plan(study.rates()).splitlines() if "FileScan" in line)
    assert "crime_type" not in scan and "ed_level" not in scan
    assert "LessThanOrEqual(sentence_date,2014-01-02), Or" in scan
    scan = next(line for line in plan(study.mix("ed_level", "crime_type")).splitlines() if "FileScan" in line)
    assert "LessThanOrEqual(release_date,2010-12-31)" in scan


def test_the_cohort_join_broadcasts_nothing_and_reads_no_extra_columns(study):
    """The cohort is written before, so its plan holds one scan of the episodes and one of the cohort."""
    text = outside_subqueries(plan(REPORTS["cohort_episodes"](study)))
    assert "BroadcastExchange" not in text and len(re.findall(EPISODE_SCAN, text)) == 1
    joined = cohort_episodes(study.episodes, SPEC, WINDOW, ties="weighted").select("pers_id", "crime_type")
    assert "ed_level" not in plan(joined)


def test_consistent_values_are_hashed_not_sorted(study):
    text = plan(study.entity_attributes["risk"])
    below = text[text.rindex("Exchange") :]
    assert "Sort" not in below and "HashAggregate" in below


ORDERS = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["rates_overall", "cohort_weighted", "status_priority_mix"])
def test_the_date_bound_reaches_the_scan_of_orders(spark, study, name):
    scans = [line for line in plan(QUERIES[name](spark, ORDERS)).splitlines() if "FileScan" in line]
    assert any("o_orderdate" in s and "LessThan" in s.split("PushedFilters")[1] for s in scans)


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["cohort_episodes", "prepared_cohort"])
def test_row_level_results_scan_the_lines_twice_at_most(spark, study, name):
    text = plan(QUERIES[name](spark, ORDERS))
    assert text.count("l_shipdate") and len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", text)) <= 2


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["rates_by_cohort", "counted_invalid", "records_with_distinct_status"])
def test_one_scan_of_the_rows(spark, study, name):
    from recurra.orders import queries

    df = queries.QUERIES[name](spark, ORDERS)
    if name == "rates_by_cohort":
        assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan(df))) == 1
    assert "Python" not in plan(df)


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
def test_all_reports_read_no_episodes_again(spark, study):
    text = plan(QUERIES["all_reports"](spark, ORDERS))
    assert "l_orderkey" not in text and "o_orderkey" not in text


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
def test_saved_tables_are_not_shuffled_by_customer(spark, study):
    text = plan(QUERIES["saved_cohort_rates"](spark, ORDERS))
    assert "SortMergeJoin" in text and "hashpartitioning(custkey" not in text


def shuffled(node) -> list[tuple[str, int]]:
    """(partitioning, rows written) of the exchanges of a plan that ran."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return shuffled(node.executedPlan())
    if "QueryStage" in name:
        return shuffled(node.plan())
    found = []
    if name == "Exchange":
        found.append((node.outputPartitioning().toString(), node.metrics().apply("shuffleRecordsWritten").value()))
    children = node.children()
    for i in range(children.size()):
        found += shuffled(children.apply(i))
    return found


@pytest.mark.skipif(not Path(ORDERS).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["cohort_episodes", "classified_episodes"])
def test_hardly_more_episodes_are_shuffled_than_the_cohort_has(spark, study, name):
    folder = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, folder)
    rows = len(df.collect())
    found = shuffled(df._jdf.queryExecution().executedPlan())
    by_customer = [n for by, n in found if "custkey" in by]
    whole = QUERIES["parquet_table"](spark, folder).count()
    # The larger of the two sides is that of the episodes.
    assert max(by_customer) < 1.05 * rows < whole / 2
    by_order = [n for by, n in found if "orderkey" in by]
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert min(by_order) < orders / 2

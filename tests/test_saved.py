"""Tables saved by end year and in buckets."""

from __future__ import annotations

from collections import Counter
from datetime import date
from pathlib import Path

import pytest

from recurra import (
    CohortWindow,
    EpisodeSpec,
    build_cohort,
    classify_prepared,
    cohort_episodes,
    consistent_attribute,
    prepared_rates,
    read_bucketed,
    read_years,
    replace_years,
    valid_episodes,
    write_bucketed,
    write_years,
)
from recurra.operators.mix import category_counts
from recurra.settings import remove_tables
from tests import brute_force as bf

SPEC = EpisodeSpec(entity_nullable=False)
WINDOW = CohortWindow.of_year(2010)


def bag(df):
    return Counter(map(tuple, df.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def rows():
    return [r for r in bf.random_episodes(6, 1200) if r[0] is not None]


def test_a_year_is_replaced_and_others_stay(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, bf.SCHEMA)
    path = str(tmp_path / "years")
    write_years(df, path, SPEC)
    assert bag(read_years(spark, path)) == Counter(rows)
    with pytest.raises(Exception, match="already exists"):
        write_years(df, path, SPEC)
    new = [(1, date(2010, 5, 1), date(2010, 6, 1), "Drug", "A"), (2, date(2009, 5, 1), date(2010, 6, 1), None, "B")]
    replace_years(spark.createDataFrame(new, bf.SCHEMA), path, SPEC)
    others = [r for r in rows if r[2] is None or r[2].year != 2010]
    assert bag(read_years(spark, path)) == Counter(others + new)
    assert bag(read_years(spark, path, 2010, 2010)) == Counter(new)
    assert bag(read_years(spark, path, last=2009)) == Counter(r for r in rows if r[2] and r[2].year <= 2009)
    replace_years(spark.createDataFrame([], bf.SCHEMA), path, SPEC)
    assert bag(read_years(spark, path)) == Counter(others + new)


def test_a_cohort_reads_only_its_years(spark, tmp_path, rows):
    path = str(tmp_path / "years")
    write_years(spark.createDataFrame(rows, bf.SCHEMA), path, SPEC)
    early = read_years(spark, path, last=2010)
    cohort = build_cohort(valid_episodes(early, SPEC), SPEC, WINDOW)
    assert bag(cohort.select("pers_id", "original_sentence_date", "original_release_date")) == Counter(bf.cohort(rows, 2010))
    scans = [line for line in plan(cohort).splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "end_year" in scans[0].split("PartitionFilters")[1].split("]")[0]
    years = [int(p.name.split("=")[1]) for p in Path(path).glob("end_year=2*")]
    metrics = early._jdf.queryExecution().executedPlan().execute().count()
    assert metrics == sum(r[2] is not None and r[2].year <= 2010 for r in rows) and max(years) > 2010


def saved(spark, tmp_path, rows):
    episodes = valid_episodes(spark.createDataFrame(rows, bf.SCHEMA), SPEC)
    cohort = cohort_episodes(episodes, SPEC, WINDOW)
    records = [r for r in bf.random_risks(6) if r[0] is not None]
    risk = consistent_attribute(spark.createDataFrame(records, "pers_id bigint, risk string"), "pers_id", "risk")
    write_bucketed(cohort, f"{tmp_path}/cohort", ["pers_id"], 4)
    write_bucketed(risk, f"{tmp_path}/risk", ["pers_id"], 4)
    return cohort, risk


def test_saved_buckets_meet_without_a_shuffle(spark, tmp_path, rows, no_broadcast):
    cohort, risk = saved(spark, tmp_path, rows)
    tables = read_bucketed(spark, f"{tmp_path}/cohort"), read_bucketed(spark, f"{tmp_path}/risk")
    assert bag(tables[0]) == bag(cohort) and bag(tables[1]) == bag(risk)
    assert len(list(Path(f"{tmp_path}/cohort/rows").glob("part-*.parquet"))) <= 4
    classified = classify_prepared(*tables, SPEC, bucketed=True)
    rates = prepared_rates(classified, SPEC, "risk")
    text = plan(rates)
    assert "SortMergeJoin" in text and "hashpartitioning(pers_id" not in text
    assert text.count("Exchange") == 1 and "hashpartitioning(risk" in text
    assert "hashpartitioning" not in plan(classified)
    assert bag(rates) == bag(prepared_rates(classify_prepared(cohort, risk, SPEC), SPEC, "risk"))
    assert bag(category_counts(classified, "risk", "crime_type")) == bag(
        category_counts(classify_prepared(cohort, risk, SPEC), "risk", "crime_type")
    )


def test_names_of_saved_tables_are_forgotten_but_not_their_files(spark, tmp_path, rows):
    cohort, _ = saved(spark, tmp_path, rows)
    read_bucketed(spark, f"{tmp_path}/cohort").count()
    expected = bag(cohort)
    remove_tables(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    assert bag(read_bucketed(spark, f"{tmp_path}/cohort")) == expected

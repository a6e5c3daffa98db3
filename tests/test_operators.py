"""Edge cases of single operators."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recurra import (
    CohortWindow,
    EpisodeSpec,
    ReturnStudy,
    add_case_ids,
    add_entity_attribute,
    add_horizons,
    build_cohort,
    chart_table,
    classify_return,
    clean_episodes,
    cohort_episodes,
    columns_between,
    columns_first,
    columns_with_prefix,
    consistent_attribute,
    distinct_values,
    in_row_order,
    number_keys,
    order_levels,
    rates_long,
    rejected_episodes,
    return_flags,
    return_rates,
    valid_episodes,
)
from tests import brute_force as bf

SPEC = EpisodeSpec()
D = date(2010, 3, 15)
INDEX = "pers_id bigint, sentence_date date, original_release_date date"


def episodes(spark, rows):
    return spark.createDataFrame([(*r, "Drug", "A") if len(r) == 3 else r for r in rows], bf.SCHEMA)


def test_classes_at_every_bound(spark):
    expected = {
        date(2010, 3, 14): None,
        D: None,
        date(2010, 3, 16): 1,
        date(2011, 3, 15): 1,
        date(2011, 3, 16): 2,
        date(2012, 3, 15): 2,
        date(2012, 3, 16): 3,
        date(2013, 3, 15): 3,
        date(2013, 3, 16): 4,
    }
    df = add_horizons(spark.createDataFrame([(1, s, D) for s in expected], INDEX), SPEC)
    found = {r["sentence_date"]: r["years_since_original_release"] for r in classify_return(df, SPEC).collect()}
    assert found == expected


def test_leap_day_index_counts_every_return_as_late(spark):
    leap = date(2012, 2, 29)
    df = add_horizons(spark.createDataFrame([(1, date(2012, 6, 1), leap), (1, leap, leap)], INDEX), SPEC)
    rows = classify_return(df, SPEC).collect()
    assert [r["years_since_original_release"] for r in rows] == [4, None]
    assert all(r[f"original_release_date_plus_{n}"] is None for r in rows for n in (1, 2, 3))


def test_a_null_cut_point_closes_the_horizons_beside_it(spark):
    horizons, leap = (1, 4, 8), date(2012, 2, 29)
    starts = [date(2012, 6, 1), date(2015, 6, 1), date(2017, 6, 1), date(2021, 1, 1)]
    df = add_horizons(spark.createDataFrame([(1, s, leap) for s in starts], INDEX), SPEC, horizons)
    found = [r["years_since_original_release"] for r in classify_return(df, SPEC, horizons).collect()]
    assert found == [9, 9, 8, 9]


def test_flags_are_cumulative_and_never_null(spark):
    rows = [(1, None), (1, None), (2, 3), (3, 2), (3, 4), (4, 1), (4, 3), (5, 4)]
    df = spark.createDataFrame(rows, "pers_id bigint, years_since_original_release int")
    flags = return_flags(df, ["pers_id"])
    assert {tuple(r) for r in flags.collect()} == {
        (1, 0, 0, 0),
        (2, 0, 0, 1),
        (3, 0, 1, 1),
        (4, 1, 1, 1),
        (5, 0, 0, 0),
    }
    assert tuple(return_rates(flags).first()) == (0.2, 0.4, 0.6)


def test_empty_cohort(spark):
    study = ReturnStudy(episodes(spark, [(1, D, date(2011, 1, 1))]), SPEC, CohortWindow.of_year(1999))
    assert tuple(study.rates().first()) == (None, None, None)
    assert study.rates("crime_type").count() == 0
    assert study.mix("crime_type", "ed_level").count() == 0


def test_tied_index_rows_repeat_every_episode(spark):
    rows = [(1, date(2009, 1, 1), D)] * 2 + [(1, date(2011, 1, 1), date(2011, 5, 1))]
    df, window = episodes(spark, rows), CohortWindow.of_year(2010)
    assert build_cohort(df, SPEC, window).count() == 2
    assert cohort_episodes(df, SPEC, window, ties="all").count() == 6
    assert cohort_episodes(df, SPEC, window).count() == 3
    assert cohort_episodes(df, SPEC, window, ties="one").count() == 3
    assert tuple(ReturnStudy(df, SPEC, window).rates().first()) == (1.0, 1.0, 1.0)
    assert ReturnStudy(df, SPEC, window).mix("ed_level", "crime_type").first()["n"] == 4
    with pytest.raises(ValueError):
        build_cohort(df, SPEC, window, ties="some")


def test_equal_rows_are_dealt_out_before_they_are_repeated(spark):
    """1,500 equal rows make 2,250,000 rows if they are asked for, over all tasks."""
    rows = spark.createDataFrame([(1, date(2009, 1, 1), D, "Drug", "A")], bf.SCHEMA)
    many = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1500)))).drop("n").repartition(4)
    made = cohort_episodes(many, SPEC, CohortWindow.of_year(2010), ties="all")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == 1500 * 1500 and len(per_task) >= 6 and max(per_task) < sum(per_task) / 2


def test_horizons_must_grow(spark):
    df = episodes(spark, [(1, date(2009, 1, 1), D)])
    for wrong in ((), (2, 1), (1, 1), (0, 1)):
        with pytest.raises(ValueError):
            ReturnStudy(df, SPEC, CohortWindow.of_year(2010), horizons=wrong)
        with pytest.raises(ValueError):
            classify_return(df, SPEC, wrong)


def test_an_invalid_first_episode_does_not_count(spark):
    rows = [(1, date(2009, 6, 1), date(2009, 1, 1)), (1, date(2009, 2, 1), date(2009, 2, 1)), (1, date(2009, 3, 1), D)]
    cohort = build_cohort(valid_episodes(episodes(spark, rows), SPEC), SPEC, CohortWindow.of_year(2010))
    assert [r["original_release_date"] for r in cohort.collect()] == [D]


def test_first_end_before_the_window_excludes(spark):
    rows = [(1, date(2008, 1, 1), date(2009, 12, 31)), (1, date(2009, 1, 1), D), (2, date(2009, 1, 1), date(2011, 1, 1))]
    assert build_cohort(episodes(spark, rows), SPEC, CohortWindow.of_year(2010)).count() == 0


def test_cleaning_and_rejects(spark):
    raw = spark.createDataFrame(
        [
            (1, "01jan2010", "02jan2010", "Drug", "A"),
            (2, "02jan2010", "01jan2010", "Drug", "A"),
            (3, "02jan2010", "02jan2010", "Drug", "A"),
            (4, "", "02jan2010", None, "A"),
            (5, "02jan2010", "31feb2010", None, "A"),
        ],
        "pers_id bigint, sentence_date string, release_date string, crime_type string, ed_level string",
    )
    clean = clean_episodes(raw, SPEC, case_ids=True)
    assert clean.columns[:2] == ["case_id", "pers_id"]
    assert [tuple(r)[:4] for r in clean.collect()] == [(1, 1, date(2010, 1, 1), date(2010, 1, 2))]
    parsed = clean_episodes(raw, SPEC)
    assert parsed.columns == SPEC.columns
    from recurra import parse_date_columns

    rejected = rejected_episodes(parse_date_columns(raw), SPEC).collect()
    assert {r["pers_id"]: r["reason"] for r in rejected} == {
        2: "end before start",
        3: "zero length",
        4: "missing date",
        5: "missing date",
    }


def test_consistent_attribute(spark):
    rows = [(1, "A"), (2, "A"), (2, "A"), (3, "A"), (3, "B"), (4, "A"), (4, None), (5, None), (5, None), (None, "B")]
    df = spark.createDataFrame(rows, "pers_id bigint, risk string")
    kept = {tuple(r) for r in consistent_attribute(df, "pers_id", "risk").collect()}
    assert kept == {(1, "A"), (2, "A"), (5, None), (None, "B")}
    counts = {r["pers_id"]: r["distinct_values"] for r in distinct_values(df, "pers_id", "risk").collect()}
    assert counts == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, None: 1}


def test_attribute_join_matches_null_entities(spark):
    people = spark.createDataFrame([(1,), (None,), (3,)], "pers_id bigint")
    risk = spark.createDataFrame([(1, "A"), (None, "B")], "pers_id bigint, risk string")
    joined = add_entity_attribute(people, risk, SPEC)
    assert {tuple(r) for r in joined.collect()} == {(1, "A"), (None, "B"), (3, None)}
    strict = add_entity_attribute(people, risk, EpisodeSpec(entity_nullable=False))
    assert {tuple(r) for r in strict.collect()} == {(1, "A"), (None, None), (3, None)}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_case_ids_equal_global_dense_rank(spark, partitions):
    rows = bf.random_episodes(11, n=700)
    df = episodes(spark, rows).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = add_case_ids(df, SPEC).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    assert {tuple(r)[:3]: r["case_id"] for r in found} == bf.case_ids(rows)


def test_case_ids_over_many_partitions(spark):
    ids = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_keys(ids, ["k"])
        wrong = numbered.where(F.col("case_id") != F.col("k") + 1).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (wrong, numbered.count()) == (0, 5000)


def test_case_ids_of_nothing(spark):
    assert number_keys(spark.range(0).select(F.col("id").alias("k")), ["k"]).count() == 0


def test_columns_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, b2 int, c int")
    assert columns_first(df, "c", "a").columns == ["c", "a", "b", "b2"]
    assert columns_between(df, "b", "c") == ["b", "b2", "c"]
    assert columns_with_prefix(df, "b") == ["b", "b2"]


def test_long_form_and_chart(spark):
    names = ["prop_recidivism_year_1", "prop_recidivism_year_2", "prop_recidivism_year_3"]
    schema = "ed string, " + ", ".join(f"{n} double" for n in names)
    rates = spark.createDataFrame([("x", 0.1, 0.2, 0.3), ("z", 0.1225, 0.5, 1.0), (None, 0.0, 0.0, 0.0)], schema)
    long = rates_long(rates)
    assert long.columns == ["ed", "years_since_original_release", "prop_recidivism"]
    assert {tuple(r) for r in long.where("ed = 'x'").collect()} == {("x", "1", 0.1), ("x", "2", 0.2), ("x", "3", 0.3)}
    chart = chart_table(rates, "ed", ["z", "y"], drop_null_level=True).collect()
    assert {(r["ed"], r["ed_order"], r["label"]) for r in chart} == {
        (None, None, "10.0%"),
        (None, None, "20.0%"),
        (None, None, "30.0%"),
        ("z", 1, "12.2%"),
        ("z", 1, "50.0%"),
        ("z", 1, "100.0%"),
    }
    assert chart_table(rates.drop("ed")).columns == ["years_since_original_release", "prop_recidivism", "label"]
    ordered = order_levels(rates, "ed", ["z"]).select("ed", "ed_order").collect()
    assert {tuple(r) for r in ordered} == {("z", 1), (None, None)}


def test_row_order_puts_nulls_last(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 2), (1, 1), (1, 1)], "a int, b int")
    assert [tuple(r) for r in in_row_order(df, "a", "b").collect()] == [(1, 1), (1, 1), (1, 2), (2, 2), (None, 1)]


def test_number_keys_agrees_with_window_on_strings(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 97).alias("k"))
    ranked = df.distinct().withColumn("expected", F.dense_rank().over(Window.orderBy("k")))
    joined = number_keys(df, ["k"]).join(ranked, "k")
    assert joined.where("case_id = expected").count() == 97

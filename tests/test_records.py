"""First records in file order, and group statistics beside records."""

from __future__ import annotations

import random

import pytest

from recurra import (
    EpisodeSpec,
    add_distinct_values,
    consistent_records,
    first_records,
    read_episode_files,
    read_table,
)

SPEC = EpisodeSpec()
HEADER = "pers_id,sentence_date,release_date,crime_type,ed_level"


@pytest.fixture
def records(spark, tmp_path):
    """Records of 60 persons in three files, and the first of each and all of each by plain reading."""
    rng = random.Random(4)
    first, every = {}, {}
    for name in ("a_releases.csv", "b_releases.csv", "c_releases.csv"):
        lines = [HEADER]
        for _ in range(400):
            person = rng.choice([None, *range(60)])
            rest = tuple(rng.choice([f"{c}{i}" for i in range(3)] + [None]) for c in "wxyz")
            lines.append(",".join("NA" if v is None else str(v) for v in (person, *rest)))
            first.setdefault(person, rest)
            every.setdefault(person, []).append(rest)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path), first, every


@pytest.fixture(params=[None, "2k"])
def split(spark, request):
    """Files as a whole, and in many blocks."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("partitions", [1, 7])
def test_the_first_record_is_the_first_in_the_files(spark, records, split, partitions):
    folder, first, _ = records
    df = read_episode_files(spark, folder, SPEC, files="*.csv", multi_line=False, order=True)
    assert not split or df.rdd.getNumPartitions() > 3
    found = first_records(df.repartition(partitions), ["pers_id"], "record_order")
    assert found.columns == SPEC.columns
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == first and found.count() == len(first)


def test_order_follows_files_and_lines(spark, records, split):
    folder, *_ = records
    df = read_episode_files(spark, folder, SPEC, files="*.csv", multi_line=False, order=True)
    plain = [line for name in "abc" for line in open(f"{folder}/{name}_releases.csv").read().split("\n")[1:-1]]
    rows = df.orderBy("record_order").drop("record_order").collect()
    assert [",".join("NA" if v is None else str(v) for v in r) for r in rows] == plain


def test_consistent_records_are_first_ones_of_keys_that_agree(spark, records):
    folder, first, every = records
    df = read_episode_files(spark, folder, SPEC, files="*.csv", multi_line=False, order=True)
    few = df.where("pers_id < 3 or pers_id is null or ed_level = 'z1' or (pers_id = 5 and ed_level is null)")
    found = {r[0]: r[4] for r in consistent_records(few, "pers_id", "ed_level", "record_order").collect()}
    kept = few.collect()
    values = {p: {r[4] for r in kept if r[0] == p} for p in {r[0] for r in kept}}
    assert found == {p: next(iter(v)) for p, v in values.items() if len(v) == 1}
    assert len(found) > 20 and None not in found
    expected = {}
    for r in few.orderBy("record_order").collect():
        expected.setdefault(r[0], tuple(r[1:5]))
    rows = consistent_records(few, "pers_id", "ed_level", "record_order")
    assert {r[0]: tuple(r[1:]) for r in rows.collect()} == {p: expected[p] for p in found} and rows.columns == SPEC.columns


@pytest.mark.parametrize("values, kept", [("A", 1), ("AA", 1), ("AB", 0), ("A-", 0), ("-", 1), ("--", 1)])
def test_which_values_agree(spark, values, kept):
    rows = [(1, None if v == "-" else v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k bigint, v string, o int")
    assert consistent_records(df, "k", "v", "o").count() == kept


def test_records_of_keys_alone(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (None, 2)], "k bigint, o int")
    assert sorted(map(tuple, first_records(df, ["k"], "o").collect()), key=str) == [(1,), (None,)]


def test_every_record_beside_its_group(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (2, "B"), (None, "A"), (None, "C")], "k bigint, v string")
    found = add_distinct_values(df, "k", "v")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "A", 2), (1, "A", 2), (1, None, 2), (2, "B", 1), (None, "A", 2), (None, "C", 2)], key=str
    )


def test_order_of_a_saved_table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(50)], "k bigint, v string")
    df.coalesce(1).write.csv(f"{tmp_path}/t", header=True)
    read = read_table(spark, f"{tmp_path}/t", df.schema, "csv", order=True)
    assert {r["v"]: r["k"] for r in first_records(read, ["v"], "record_order").collect()} == {"t0": 0, "t1": 1, "t2": 2}

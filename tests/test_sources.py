from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import types as T

from recurra import (
    EpisodeSpec,
    attribute_schema,
    clean_episodes,
    read_attribute_file,
    read_episode_files,
    read_rejects,
    read_table,
    reject_counts,
    write_table,
)
from recurra.__main__ import main
from recurra.settings import CHECKPOINT_DIR, shared_folder, use_local_folder

SPEC = EpisodeSpec()
HEADER = "pers_id,sentence_date,release_date,crime_type,ed_level"


@pytest.fixture
def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    first = [HEADER, "1,01jan2009,15mar2010,Drug,Some college", "1,01jan2009,15mar2010,,Some college"]
    second = [HEADER, "2, 02feb2009 ,31dec2010,NA,Associate degree", "1,16mar2011,01may2011,Violent,Some college"]
    (folder / "releases_2010.csv").write_text("\r\n".join(first) + "\r\n")
    (folder / "all_releases_2011.csv").write_text("\n".join([*second, "NA,,NA,Drug,NA"]) + "\n")
    (folder / "risk_score.csv").write_text("pers_id,risk\n1,High\n1,High\n2,Med\n3,NA\n")
    (folder / "releases_2010.txt").write_text("not,a,match\n")
    return folder


def test_files_are_chosen_by_name_and_stacked(spark, raw_folder):
    df = read_episode_files(spark, str(raw_folder), SPEC)
    assert df.columns == SPEC.columns
    assert sorted(df.collect(), key=str) == sorted(
        [
            (1, "01jan2009", "15mar2010", "Drug", "Some college"),
            (1, "01jan2009", "15mar2010", None, "Some college"),
            (2, "02feb2009", "31dec2010", None, "Associate degree"),
            (1, "16mar2011", "01may2011", "Violent", "Some college"),
            (None, None, None, "Drug", None),
        ],
        key=str,
    )


def test_attribute_file(spark, raw_folder):
    df = read_attribute_file(spark, str(raw_folder / "risk_score.csv"), SPEC, "risk")
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "High"), (1, "High"), (2, "Med"), (3, None)]


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "releases.csv").write_text("id,sentence_date,release_date,crime_type,ed_level\n1,a,b,c,d\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_episode_files(spark, str(tmp_path), SPEC).collect()


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_written_tables_come_back(spark, tmp_path, form):
    rows = [(1, date(2010, 1, 1), None, "a,b", 0.1), (None, None, date(2012, 2, 29), None, 2.5)]
    df = spark.createDataFrame(rows, "k bigint, first_date date, last_date date, name string, x double")
    path = str(tmp_path / "table")
    write_table(df, path, form)
    assert set(read_table(spark, path, df.schema, form).collect()) == set(df.collect())
    with pytest.raises(Exception, match="already exists"):
        write_table(df, path, form)


def test_csv_text_of_dates_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(date(2010, 1, 2), None)], "day date, name string")
    write_table(df, str(tmp_path / "t"), "csv")
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert set(lines) == {"day,name", "2010-01-02T00:00:00Z,NA"}


def test_unknown_form(spark, tmp_path):
    with pytest.raises(ValueError):
        write_table(spark.range(1), str(tmp_path / "x"), "json")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x"), None, "csv")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x"), None, "json")


@pytest.mark.parametrize("form, ties", [("csv", "all"), ("parquet", "weighted")])
def test_commands(spark, raw_folder, tmp_path, form, ties, capsys):
    with open(raw_folder / "releases_2010.csv", "a", newline="") as file:
        file.write("5,01jan2009\r\nx,01jan2009,15mar2010,Drug,Some college\r\ny,,,,\r\n")
    with open(raw_folder / "risk_score.csv", "a") as file:
        file.write("9\n")
    prepared, out = str(tmp_path / "prepared"), str(tmp_path / "out")
    common = ["--form", form, "--ties", ties]
    risk = str(raw_folder / "risk_score.csv")
    main(["prepare", "--episodes", str(raw_folder), "--risk", risk, "--out", prepared, "--sort", *common])
    said = capsys.readouterr().out.splitlines()
    assert sorted(line for line in said if "left out" in line) == [
        "episodes: 1 left out, wrong number of fields",
        "episodes: 2 left out, pers_id is no bigint",
        "risk: 1 left out, wrong number of fields",
    ]
    main(["report", "--prepared", prepared, "--out", out, *common])

    def rows(name):
        table = spark.read.parquet(f"{out}/{name}") if form == "parquet" else spark.read.csv(f"{out}/{name}", header=True)
        return table

    overall = {str(r["years_since_original_release"]): r["label"] for r in rows("overall").collect()}
    assert overall == {"1": "0.0%", "2": "50.0%", "3": "50.0%"}
    assert rows("by_education").count() == 6
    mix = {(r["risk"], r["label"]) for r in rows("crime_mix_by_risk").collect()}
    assert mix == {("High", "50%"), ("Med", "100%")}
    assert rows("by_duration").select("label").count() == 3


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get(CHECKPOINT_DIR)


class FakeSession:
    """A session on ``master`` with the given setting."""

    def __init__(self, master, named=None, used=None):
        self.conf, self.sparkContext = self, self
        self.master, self.named, self.used = master, named, used

    def get(self, key, default):
        return self.named or default

    def getCheckpointDir(self):
        return self.used

    def setCheckpointDir(self, folder):
        self.used = folder


def test_a_session_needs_a_named_folder():
    assert shared_folder(FakeSession("yarn", named="hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(FakeSession("yarn", used="hdfs:///used")) == "hdfs:///used"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        cluster = FakeSession(master)
        use_local_folder(cluster)
        with pytest.raises(ValueError, match=CHECKPOINT_DIR):
            shared_folder(cluster)
    local = FakeSession("local[2]")
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_folder(local)
    use_local_folder(local)
    assert shared_folder(local) == local.used


@pytest.mark.parametrize("multi_line", [True, False])
def test_quotes_are_kept_and_bad_records_come_back_with_the_reason(spark, tmp_path, multi_line):
    lines = ["pers_id,risk", '1,"say ""hi"", x"', "4,Med,extra", "5", "abc,Med", ' 7 , " padded " ', "NA,Low", "8,"]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    schema = attribute_schema(SPEC, "risk")
    good = read_attribute_file(spark, str(tmp_path / "r.csv"), SPEC, "risk", multi_line)
    assert set(map(tuple, good.collect())) == {(1, 'say "hi", x'), (7, " padded "), (None, "Low"), (8, None)}
    bad = read_rejects(spark, str(tmp_path / "r.csv"), schema, multi_line)
    assert set(map(tuple, bad.collect())) == {
        ("4,Med,extra", "wrong number of fields"),
        ("5", "wrong number of fields"),
        ("abc,Med", "pers_id is no bigint"),
    }
    assert good.select("pers_id").count() == 4


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'pers_id,risk\r\n6,"two\nlines"\r\n7,"a\r\nb"\r\n')
    rows = read_attribute_file(spark, str(tmp_path / "r.csv"), SPEC, "risk").collect()
    assert sorted(map(tuple, rows)) == [(6, "two\nlines"), (7, "a\nb")]


def test_text_comes_back_as_it_was(spark, tmp_path):
    texts = ["  padded\t", 'say "hi"', '"', ",", "two\nlines", "\n", "a\r\nb", "back\\slash", "", None, 'end\\"', "é漢🙂"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    write_table(df, str(tmp_path / "t"), "csv")
    assert set(read_table(spark, str(tmp_path / "t"), df.schema, "csv").collect()) == set(df.collect())


def test_dates_that_are_none_are_rejected(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,day\n1,2010-01-02T00:00:00Z\n2,2010-02-31T00:00:00Z\n3,soon\n4,NA\n")
    schema = spark.createDataFrame([], "k int, day date").schema
    rows = read_table(spark, str(tmp_path / "t.csv"), schema, "csv").collect()
    assert sorted(map(tuple, rows)) == [(1, date(2010, 1, 2)), (4, None)]
    bad = read_rejects(spark, str(tmp_path / "t.csv"), schema, trim=False)
    assert {r["reason"] for r in bad.collect()} == {"day is no date"} and bad.count() == 2


def test_clean_accepts_dates_that_are_parsed_already(spark):
    df = spark.createDataFrame([(1, date(2010, 1, 1), date(2010, 1, 2), "a", "b")],
                               "pers_id bigint, sentence_date date, release_date date, crime_type string, ed_level string")
    assert clean_episodes(df, SPEC).count() == 1


@pytest.mark.parametrize("multi_line", [True, False])
def test_tables_of_text_only_can_be_counted(spark, tmp_path, multi_line):
    (tmp_path / "r.csv").write_text('pers_id,risk\na,b\nc\nd,"x, y"\n,\n')
    text = EpisodeSpec(entity_type=T.StringType())
    schema = attribute_schema(text, "risk")
    rows = [("a", "b"), ("d", "x, y"), (None, None)]
    for read in (
        read_attribute_file(spark, str(tmp_path / "r.csv"), text, "risk", multi_line),
        read_table(spark, str(tmp_path / "r.csv"), schema, "csv", multi_line),
    ):
        assert read.count() == 3 and not read.isEmpty()
        assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    bad = read_rejects(spark, str(tmp_path / "r.csv"), schema, multi_line)
    assert bad.count() == 1 and not bad.isEmpty() and tuple(bad.first()) == ("c", "wrong number of fields")
    (tmp_path / "releases.csv").write_text(HEADER + "\na,b,c,d,e\nf\n")
    assert read_episode_files(spark, str(tmp_path), text, multi_line=multi_line).count() == 1


def test_lines_without_breaks_are_read_in_splits(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text, {i}") for i in range(5000)], "k bigint, text string").coalesce(1)
    write_table(df, str(tmp_path / "t"), "csv", multi_line=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = read_table(spark, str(tmp_path / "t"), df.schema, "csv", multi_line=False)
        assert read.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    broken = spark.createDataFrame([("a\nb",)], "text string")
    with pytest.raises(Exception, match="line break"):
        write_table(broken, str(tmp_path / "u"), "csv", multi_line=False)


def test_values_are_computed_once(spark, tmp_path):
    df = spark.createDataFrame([(date(2010, 1, 2), 1.5)], "day date, x double")
    write_table(df, str(tmp_path / "t"), "csv")
    read = read_table(spark, str(tmp_path / "t"), df.schema, "csv")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.lower().count("as double") == 1


def test_rejects_are_counted_while_a_table_is_written(spark, tmp_path):
    lines = ["pers_id,risk", "1,a", "x,b", "2", "3,c,d", "y,e", "4,"]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    counts = Observation("rejects")
    good = read_attribute_file(spark, str(tmp_path / "r.csv"), SPEC, "risk", counts=counts)
    write_table(good, str(tmp_path / "out"))
    found = set(map(tuple, reject_counts(spark, counts).collect()))
    rejects = read_rejects(spark, str(tmp_path / "r.csv"), attribute_schema(SPEC, "risk"))
    assert found == set(map(tuple, rejects.groupBy("reason").count().collect())) == {
        ("wrong number of fields", 2),
        ("pers_id is no bigint", 2),
    }
    assert counts.get["kept"] == spark.read.parquet(str(tmp_path / "out")).count() == 2

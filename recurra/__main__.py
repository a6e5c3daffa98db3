"""The whole analysis as two commands: ``prepare`` writes the datasets, ``report`` writes the reports.

    python -m recurra prepare --episodes FOLDER --risk FILE --out FOLDER [--year 2010] [--form csv]
    python -m recurra report --prepared FOLDER --out FOLDER [--form csv]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from recurra.functions.labels import with_automatic_labels
from recurra.operators import chart_table, in_report_order, in_row_order
from recurra.operators.cohort import TIES
from recurra.plans import (
    classify_prepared,
    prepare_attribute,
    prepare_cohort,
    prepared_mix,
    prepared_rates,
    prepared_rates_by_duration,
    prepared_schema,
)
from recurra.settings import remove_tables, use_local_folder
from recurra.sources import read_attribute_file, read_episode_files, read_table, write_table
from recurra.sources.tables import KEPT
from recurra.spec import BAND, BAND_ORDER, CASE_ID, EDUCATION_LEVELS, RETURN_CLASS, CohortWindow, EpisodeSpec

SPEC = EpisodeSpec()
RISK = "risk"


def _say_left_out(name: str, counts: Observation) -> None:
    """Print how many records a reader left out, and why."""
    for reason, n in counts.get.items():
        if n and reason != KEPT:
            print(f"{name}: {n} left out, {reason}")


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    seen, seen_risk = Observation("episodes"), Observation(RISK)
    episodes = read_episode_files(spark, args.episodes, SPEC, counts=seen)
    cohort = prepare_cohort(episodes, SPEC, CohortWindow.of_year(args.year), ties=args.ties)
    if args.sort:
        cohort = in_row_order(cohort, SPEC.entity, CASE_ID)
    write_table(cohort, f"{args.out}/cohort", args.form)
    risk = prepare_attribute(read_attribute_file(spark, args.risk, SPEC, RISK, counts=seen_risk), SPEC, RISK)
    write_table(risk, f"{args.out}/{RISK}", args.form)
    _say_left_out("episodes", seen)
    _say_left_out(RISK, seen_risk)


def reports(rows: DataFrame) -> dict[str, DataFrame]:
    """The five rate tables in long form and the category mix, in display order, from classified cohort rows."""
    mix = prepared_mix(rows, SPEC, RISK, "crime_type")
    return {
        "overall": in_report_order(chart_table(prepared_rates(rows, SPEC)), RETURN_CLASS),
        "by_education": in_report_order(
            chart_table(prepared_rates(rows, SPEC, "ed_level"), "ed_level", EDUCATION_LEVELS),
            "ed_level_order",
            RETURN_CLASS,
        ),
        "by_crime": in_report_order(
            chart_table(prepared_rates(rows, SPEC, "crime_type"), "crime_type"), "crime_type", RETURN_CLASS
        ),
        "by_risk": in_report_order(
            chart_table(prepared_rates(rows, SPEC, RISK), RISK, drop_null_level=True), RISK, RETURN_CLASS
        ),
        "by_duration": in_report_order(
            chart_table(prepared_rates_by_duration(rows, SPEC), BAND), BAND_ORDER, RETURN_CLASS
        ),
        "crime_mix_by_risk": in_report_order(with_automatic_labels(mix, "prop"), RISK, "crime_type"),
    }


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    attribute = T.StructType().add(SPEC.entity, SPEC.entity_type).add(RISK, T.StringType())
    cohort = read_table(spark, f"{args.prepared}/cohort", prepared_schema(SPEC, ties=args.ties), args.form)
    risk = read_table(spark, f"{args.prepared}/{RISK}", attribute, args.form)
    rows = classify_prepared(cohort, risk, SPEC).persist()
    for name, table in reports(rows).items():
        write_table(table, f"{args.out}/{name}", args.form)
    rows.unpersist()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m recurra")
    commands = parser.add_subparsers(required=True)
    first = commands.add_parser("prepare")
    first.add_argument("--episodes", required=True, help="folder with the episode CSV files")
    first.add_argument("--risk", required=True, help="CSV file with one attribute record per line")
    first.add_argument("--year", type=int, default=2010, help="year of the first end dates")
    first.add_argument("--sort", action="store_true", help="sort the cohort by entity and case")
    first.set_defaults(run=prepare)
    second = commands.add_parser("report")
    second.add_argument("--prepared", required=True, help="what prepare wrote")
    second.set_defaults(run=report)
    for command in (first, second):
        command.add_argument("--out", required=True)
        command.add_argument("--form", choices=["parquet", "csv"], default="parquet")
        command.add_argument("--ties", choices=TIES, default="weighted")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("recurra").getOrCreate()
    use_local_folder(spark)
    args.run(spark, args)
    remove_tables(spark)


if __name__ == "__main__":
    main()

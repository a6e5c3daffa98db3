"""Tables of episodes with one folder per year of the end date, of which years can be replaced and left unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.spec import EpisodeSpec

END_YEAR = "end_year"


def _by_year(df: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """Rows of a year are brought together, in as many tasks as their size asks for."""
    return df.withColumn(END_YEAR, F.year(spec.end)).hint("rebalance", END_YEAR)


def write_years(df: DataFrame, path: str, spec: EpisodeSpec, mode: str = "errorifexists") -> None:
    """Write a table of episodes by the year in which they end (a date column); rows without an end are a year of their own."""
    _by_year(df, spec).write.mode(mode).partitionBy(END_YEAR).parquet(path)


def replace_years(df: DataFrame, path: str, spec: EpisodeSpec) -> None:
    """Put these rows in place of all rows of the years in which they end; other years are not touched.

    A year without a row here stays as it was. The old files of a year go when all new ones are written.
    """
    writer = _by_year(df, spec).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(END_YEAR).parquet(path)


def read_years(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Episodes that end in the years ``first`` to ``last``; folders of other years are not opened.

    Who belongs to a cohort is decided by episodes that end up to its last year. Returns are not bounded by their end.
    """
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(END_YEAR) >= first)
    if last is not None:
        df = df.where(F.col(END_YEAR) <= last)
    return df.drop(END_YEAR)

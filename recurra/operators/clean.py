"""Cleaning of raw episode tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions.dates import parse_day
from recurra.operators.ids import add_case_ids
from recurra.spec import CASE_ID, EpisodeSpec


def parse_date_columns(df: DataFrame) -> DataFrame:
    """Parse every text column whose name ends with "date"."""
    return df.withColumns(
        {
            f.name: parse_day(F.col(f.name))
            for f in df.schema.fields
            if f.name.lower().endswith("date") and isinstance(f.dataType, T.StringType)
        }
    )


def columns_first(df: DataFrame, *names: str) -> DataFrame:
    """Put the named columns first and keep the others in their order."""
    return df.select(*names, *[c for c in df.columns if c not in names])


# Why ``valid_episodes`` drops a row.
INVALID = ("missing date", "end before start", "zero length")


def _invalid(spec: EpisodeSpec) -> Column:
    """The reason for which a row is dropped, null for valid ones."""
    start, end = F.col(spec.start), F.col(spec.end)
    missing, before, zero = INVALID
    return F.when(start.isNull() | end.isNull(), missing).when(end < start, before).when(end == start, zero)


def valid_episodes(df: DataFrame, spec: EpisodeSpec, counts: Observation | None = None) -> DataFrame:
    """Keep episodes that end strictly after they start; a missing date drops the row.

    An Observation counts the rows kept and dropped, by reason, while an action such as a write passes them (see
    ``reject_counts``). Conditions that come later then stay above it, so that it sees all rows.
    """
    if counts is not None:
        reason = _invalid(spec)
        each = [F.count_if(reason == r).alias(r) for r in INVALID]
        df = df.observe(counts, F.count_if(reason.isNull()).alias("kept"), *each)
    return df.where(F.col(spec.end) > F.col(spec.start))


def rejected_episodes(df: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """The rows ``valid_episodes`` drops, with the reason."""
    return df.withColumn("reason", _invalid(spec)).where(F.col("reason").isNotNull())


def clean_episodes(
    df: DataFrame, spec: EpisodeSpec, case_ids: bool = False, counts: Observation | None = None
) -> DataFrame:
    """Parse dates, optionally number the cases, and drop invalid intervals (counted in ``counts``).

    Case ids are given before the filter, so ids of dropped cases stay unused. They cost a sort of all distinct
    cases and a join; leave them out unless they are wanted in the output.
    """
    df = parse_date_columns(df)
    if case_ids:
        df = columns_first(add_case_ids(df, spec), CASE_ID, spec.entity)
    return valid_episodes(df, spec, counts)

"""The little that must be kept of all episodes so far, to which those of a new file are added.

A state holds the day history of every entity: per start day the earliest end and how many rows have it. That tells the first
end, its tied starts, and when the entity came back, for every cohort. First ends only move to earlier days as files come in,
so days beyond the reach of the first end known so far are never needed again and are left out. States of parts are merged in
any order and grouping, with the same result as the state of the whole; no older file is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.operators.cohort import add_horizons, in_window, repeat_tied, starts_for
from recurra.operators.returns import classify_return, first_class, flags_from_first_class
from recurra.spec import HORIZONS, INDEX_ROWS, CohortWindow, EpisodeSpec

DAY_END = "first_end_of_day"


def _days(ends: DataFrame, spec: EpisodeSpec, horizons: tuple[int, ...]) -> DataFrame:
    """Rows (entity, start, end, number of rows) to the days that matter."""
    days = ends.groupBy(spec.entity, spec.start).agg(
        F.min(DAY_END).alias(DAY_END), F.min_by(INDEX_ROWS, DAY_END).alias(INDEX_ROWS)
    )
    first = F.min(DAY_END).over(Window.partitionBy(spec.entity))
    reach = F.date_add(F.col("_first"), 366 * max(horizons))
    return days.withColumn("_first", first).where(F.col(spec.start) <= reach).drop("_first")


def entity_state(episodes: DataFrame, spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """State of valid episodes: (entity, start, ``first_end_of_day``, ``index_rows``).

    An entity has at most one row per day, so the window over it is bounded by the calendar.
    """
    ends = episodes.groupBy(*spec.key).agg(F.count(F.lit(1)).alias(INDEX_ROWS))
    return _days(ends.withColumnRenamed(spec.end, DAY_END), spec, horizons)


def merge_states(state: DataFrame, *others: DataFrame, spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """State of all episodes behind several states; each episode must be in one of them."""
    for other in others:
        state = state.unionByName(other)
    ends = state.groupBy(spec.entity, spec.start, DAY_END).agg(F.sum(INDEX_ROWS).alias(INDEX_ROWS))
    return _days(ends, spec, horizons)


def _with_first_end(state: DataFrame, spec: EpisodeSpec, window: CohortWindow) -> DataFrame:
    first = F.min(DAY_END).over(Window.partitionBy(spec.entity))
    return state.withColumn(spec.index_end, first).where(in_window(spec, window))


def cohort_of_state(
    state: DataFrame,
    spec: EpisodeSpec,
    window: CohortWindow,
    horizons: tuple[int, ...] = HORIZONS,
    ties: str = "all",
) -> DataFrame:
    """The cohort with its cut points, as ``build_cohort`` makes it from the episodes."""
    index = _with_first_end(state, spec, window).where(F.col(DAY_END) == F.col(spec.index_end))
    starts = index.select(spec.entity, F.col(spec.start).alias(spec.index_start), spec.index_end, INDEX_ROWS)
    cohort = add_horizons(starts_for(starts, spec, ties), spec, horizons)
    return repeat_tied(cohort) if ties == "all" else cohort


def flags_of_state(
    state: DataFrame, spec: EpisodeSpec, window: CohortWindow, horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """One row per entity of the cohort with its cumulative return flags; the horizons must be within the state's."""
    days = add_horizons(_with_first_end(state, spec, window), spec, horizons)
    first = first_class(classify_return(days, spec, horizons), [spec.entity])
    return flags_from_first_class(first, horizons)

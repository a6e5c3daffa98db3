"""Cohorts of entities by the first end date of their episodes.

Most questions about a cohort need far less than its episodes. They are answered from *day histories*: episodes are
first grouped by entity, the wanted attributes and one date. Spark combines these groups before the shuffle and
spreads even a single entity's groups over all tasks. What is left of an entity has at most one row per calendar day,
so the second step may look at the entity as a whole in a window, however many episodes it has. With attributes it has as
many rows per day as it has levels; these meet the entity's first end in a join that splits heavy entities.

Only row-level results (``cohort_episodes``) join the cohort back to the episodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.dates import add_years
from recurra.operators.attributes import add_entity_attribute
from recurra.operators.ids import ROWS_IN_KEY
from recurra.operators.reduce import with_keys_of
from recurra.operators.skew import join_per_key
from recurra.settings import scratch_table
from recurra.spec import HORIZONS, INDEX_ROWS, CohortWindow, EpisodeSpec

TIES = ("all", "weighted", "one")
ALL = "all"

TIED_ROWS = "tied_rows"

_DAY_END = "_first_end_of_day"
_PORTION = 10_000


def in_window(spec: EpisodeSpec, window: CohortWindow) -> Column:
    return F.col(spec.index_end).between(window.first, window.last)


def add_horizons(df: DataFrame, spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add the cut points 1, 2, 3 ... years after the index end; null where the day does not exist."""
    return df.withColumns({spec.horizon(n): add_years(F.col(spec.index_end), n) for n in horizons})


def decisive_episodes(
    episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow, horizons: tuple[int, ...]
) -> DataFrame:
    """Valid episodes that decide who is in the cohort or who returned.

    An episode that ends after the window is nobody's index episode there, and leaving it out can only move the first
    end of entities whose first end lies after the window anyway.
    """
    start, end = F.col(spec.start), F.col(spec.end)
    may_be_index = end <= window.last
    may_be_return = start > window.first
    # A valid episode that ends in the window starts before its last day, so this holds for both. It concerns one column
    # only and reaches the scan of the table that has it, even where start and end come from different tables.
    return episodes.where((start <= window.latest_return(horizons)) & (may_be_index | may_be_return))


def early_episodes(episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow) -> DataFrame:
    """Valid episodes that may be index episodes: they start and end before the window is over."""
    return episodes.where((F.col(spec.end) <= window.last) & (F.col(spec.start) < window.last))


def _with_first_end(days: DataFrame, spec: EpisodeSpec, window: CohortWindow, dims: Sequence[str]) -> DataFrame:
    """Days of the cohort's entities beside the entity's first end.

    Without ``dims`` an entity has at most one row per day, which a window may hold. Levels of ``dims`` are not bounded, so
    their rows are joined with the first ends instead, and a heavy entity's rows are split. Both sides of the join come
    from one shuffle of the days, which Spark computes once.
    """
    if not dims:
        first = F.min(_DAY_END).over(Window.partitionBy(spec.entity))
        return days.withColumn(spec.index_end, first).where(in_window(spec, window))
    firsts = days.groupBy(spec.entity).agg(F.min(_DAY_END).alias(spec.index_end)).where(in_window(spec, window))
    joined = join_per_key(days, firsts, [spec.entity], "inner", spec.entity_nullable)
    # True for every row, but it keeps the day's end on this side too: both sides then are one shuffle, computed once.
    return joined.where(F.col(_DAY_END) >= F.col(spec.index_end))


def start_history(
    episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow, dims: Sequence[str] = ()
) -> DataFrame:
    """Cohort entities with one row per combination of ``dims`` and start day, and the entity's first end."""
    days = episodes.groupBy(spec.entity, *dims, spec.start).agg(F.min(spec.end).alias(_DAY_END))
    return _with_first_end(days, spec, window, dims)


def stacked_start_history(
    episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow, dims: Sequence[str], rows: bool = False
) -> DataFrame:
    """The same with the dimensions apart, as (dim, level): rows grow with the sum of levels, not with their product.

    The dimension "all" has the single level null and at most one row per entity and day. ``rows`` adds ``index_rows``, the
    number of rows that end first among those of the day; for that each end is counted before.
    """
    levels = [F.struct(F.lit(ALL).alias("dim"), F.lit(None).cast("string").alias("level"))]
    levels += [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims]
    stacked = episodes.select(spec.entity, spec.start, spec.end, F.inline(F.array(*levels)))
    key = [spec.entity, "dim", "level", spec.start]
    if rows:
        ends = stacked.groupBy(*key, spec.end).agg(F.count(F.lit(1)).alias(INDEX_ROWS))
        days = ends.groupBy(*key).agg(F.min(spec.end).alias(_DAY_END), F.min_by(INDEX_ROWS, spec.end).alias(INDEX_ROWS))
    else:
        days = stacked.groupBy(*key).agg(F.min(spec.end).alias(_DAY_END))
    return _with_first_end(days, spec, window, dims)


def is_index_day(spec: EpisodeSpec) -> Column:
    """True for the rows of ``start_history`` that hold an index episode."""
    return F.col(_DAY_END) == F.col(spec.index_end)


def index_counts(
    episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow, dims: Sequence[str] = ()
) -> DataFrame:
    """Cohort entities with the number of index rows (``index_rows``) per combination of ``dims``, and with the number of
    tied index rows of the whole entity (``tied_rows``).
    """
    early = early_episodes(episodes, spec, window)
    days = early.groupBy(spec.entity, *dims, spec.end).agg(F.count(F.lit(1)).alias(INDEX_ROWS))
    ends = days.groupBy(spec.entity, spec.end).agg(F.sum(INDEX_ROWS).alias(TIED_ROWS))
    firsts = ends.groupBy(spec.entity).agg(
        F.min(spec.end).alias(spec.index_end), F.min_by(TIED_ROWS, spec.end).alias(TIED_ROWS)
    )
    joined = join_per_key(days, firsts.where(in_window(spec, window)), [spec.entity], "inner", spec.entity_nullable)
    # No end is earlier than the first. Said as an equality, the window's dates would be inferred for one side alone, and
    # the days would be computed twice.
    return joined.where(F.col(spec.end) <= F.col(spec.index_end)).drop(spec.end)


def index_starts(episodes: DataFrame, spec: EpisodeSpec, window: CohortWindow) -> DataFrame:
    """Cohort entities with their distinct index start dates and the number of tied rows behind each."""
    pairs = early_episodes(episodes, spec, window).groupBy(*spec.key).agg(F.count(F.lit(1)).alias(ROWS_IN_KEY))
    return index_starts_of_cases(pairs, spec, window)


def index_starts_of_cases(cases: DataFrame, spec: EpisodeSpec, window: CohortWindow) -> DataFrame:
    """The same from cases: one row per entity, start and end with the number of its rows in ``_rows_in_key``."""
    cases = early_episodes(cases, spec, window)
    days = cases.groupBy(spec.entity, spec.start).agg(
        F.min(spec.end).alias(_DAY_END), F.min_by(ROWS_IN_KEY, spec.end).alias(INDEX_ROWS)
    )
    first = F.min(_DAY_END).over(Window.partitionBy(spec.entity))
    starts = days.withColumn(spec.index_end, first).where(in_window(spec, window) & is_index_day(spec))
    return starts.select(
        spec.entity, F.col(spec.start).alias(spec.index_start), spec.index_end, INDEX_ROWS
    )


def repeat_tied(df: DataFrame) -> DataFrame:
    """Turn the weight ``index_rows`` into that many equal rows.

    Equal rows are counted together first. Their copies are made in portions, so that no array grows with the weight, and
    the portions are dealt out to all tasks by a hash of row and portion: one row may stand for a large part of all rows.
    """
    portion = F.lit(_PORTION).cast("long")
    others = [c for c in df.columns if c != INDEX_ROWS]
    counted = df.groupBy(*others).agg(F.sum(INDEX_ROWS).alias(INDEX_ROWS))
    last = F.floor((F.col(INDEX_ROWS) - 1) / portion)
    portions = counted.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    portions = portions.repartition(*portions.columns)
    copies = F.least(portion, F.col(INDEX_ROWS) - F.col("_portion") * portion)
    repeated = portions.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*others)


def starts_for(starts: DataFrame, spec: EpisodeSpec, ties: str) -> DataFrame:
    """What ``ties`` leaves of the index starts."""
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}")
    if ties != "one":
        return starts
    first = F.min(spec.index_start).alias(spec.index_start)
    kept = starts.groupBy(spec.entity, spec.index_end).agg(first)
    return kept.select(spec.entity, spec.index_start, spec.index_end)


def build_cohort(
    episodes: DataFrame,
    spec: EpisodeSpec,
    window: CohortWindow,
    horizons: tuple[int, ...] = HORIZONS,
    ties: str = "all",
) -> DataFrame:
    """First-event cohort with its cut points.

    Several episodes of an entity may share its first end date. ``ties="all"`` returns one row for each of them,
    ``"weighted"`` one row per distinct start date with their number in ``index_rows``, ``"one"`` the earliest start.
    """
    starts = starts_for(index_starts(episodes, spec, window), spec, ties)
    cohort = add_horizons(starts, spec, horizons)
    return repeat_tied(cohort) if ties == "all" else cohort


def cohort_episodes(
    episodes: DataFrame,
    spec: EpisodeSpec,
    window: CohortWindow,
    horizons: tuple[int, ...] = HORIZONS,
    ties: str = "weighted",
    entity_attributes: Sequence[DataFrame] = (),
) -> DataFrame:
    """All episodes of the cohort's entities beside the cohort columns and the entity attributes.

    An entity may have *k* tied index rows; ``ties="weighted"`` says so with *k* in ``index_rows``. ``"all"`` returns each of
    its episodes *k* times, the product of two row counts; ask for it only where that is wanted.

    The cohort is computed and written first (``remove_tables`` removes it). A filter made from its entities then goes to the
    scan of the episodes, so that not all of them are shuffled to meet a few entities.
    """
    facts = starts_for(index_starts(episodes, spec, window), spec, ties)
    for attribute in entity_attributes:
        facts = add_entity_attribute(facts, attribute, spec)
    facts = scratch_table(facts)
    episodes = with_keys_of(episodes, facts, [spec.entity])
    joined = join_per_key(episodes, facts, [spec.entity], "inner", spec.entity_nullable)
    cut = add_horizons(joined, spec, horizons)
    return repeat_tied(cut) if ties == "all" else cut

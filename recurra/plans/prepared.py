"""Prepared datasets: written once, read again by later analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions.dates import average_months
from recurra.functions.labels import band, band_order
from recurra.operators.attributes import add_entity_attribute, add_episode_attribute, consistent_attribute
from recurra.operators.clean import parse_date_columns, valid_episodes
from recurra.operators.cohort import add_horizons, index_starts_of_cases, repeat_tied, starts_for
from recurra.operators.ids import ROWS_IN_KEY, number_keys
from recurra.operators.mix import category_counts, category_shares
from recurra.operators.reduce import with_keys_of
from recurra.operators.returns import classify_return, return_flags, return_rates
from recurra.operators.skew import join_per_key
from recurra.settings import scratch_table
from recurra.spec import (
    BAND,
    BAND_ORDER,
    CASE_ID,
    DURATION_BANDS,
    HORIZONS,
    INDEX_ROWS,
    MONTHS,
    Bands,
    CohortWindow,
    EpisodeSpec,
)


def _cut_points(spec: EpisodeSpec, horizons: tuple[int, ...]) -> list[str]:
    return [spec.index_start, spec.index_end, *[spec.horizon(n) for n in horizons]]


def prepared_schema(spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS, ties: str = "weighted") -> T.StructType:
    """Schema of ``prepare_cohort``, needed to read it again from CSV."""
    days = [spec.start, spec.end, *_cut_points(spec, horizons)]
    schema = T.StructType().add(CASE_ID, T.LongType()).add(spec.entity, spec.entity_type)
    for name in [*spec.columns[1:], *days[2:]]:
        schema = schema.add(name, T.DateType() if name in days else T.StringType())
    return schema.add(INDEX_ROWS, T.LongType()) if ties == "weighted" else schema


def prepare_cohort(
    raw: DataFrame,
    spec: EpisodeSpec,
    window: CohortWindow,
    horizons: tuple[int, ...] = HORIZONS,
    ties: str = "weighted",
) -> DataFrame:
    """Raw episodes to the cohort's numbered episodes with index dates and cut points.

    Cases are numbered over all raw episodes. A case is an entity with a start and an end, so the numbered cases also tell
    the index episodes, and only they meet the cohort by entity; the episodes are joined once, by case. The cohort's cases
    are written first, and a filter made from their entities keeps the other episodes out of that join's shuffle.
    """
    parsed = parse_date_columns(raw)
    cases = valid_episodes(number_keys(parsed, spec.key), spec)
    starts = starts_for(index_starts_of_cases(cases, spec, window), spec, ties)
    facts = join_per_key(cases.drop(ROWS_IN_KEY), starts, [spec.entity], "inner", spec.entity_nullable)
    facts = scratch_table(facts)
    episodes = with_keys_of(valid_episodes(parsed, spec), facts, [spec.entity])
    rows = join_per_key(episodes, facts, spec.key, "inner", spec.entity_nullable)
    rows = add_horizons(rows, spec, horizons)
    rows = repeat_tied(rows) if ties == "all" else rows
    weight = [INDEX_ROWS] if ties == "weighted" else []
    return rows.select(CASE_ID, *spec.columns, *_cut_points(spec, horizons), *weight)


def prepare_attribute(raw: DataFrame, spec: EpisodeSpec, value: str) -> DataFrame:
    """Raw attribute records to one trusted value per entity."""
    return consistent_attribute(raw, spec.entity, value)


def classify_prepared(
    prepared: DataFrame,
    attribute: DataFrame,
    spec: EpisodeSpec,
    horizons: tuple[int, ...] = HORIZONS,
    bucketed: bool = False,
) -> DataFrame:
    """Saved prepared episodes with the entity attribute and the return class, ready for the rates below.

    The attribute is joined to every saved row. ``bucketed`` says that both tables are read from buckets by entity
    (``read_bucketed``): with ``entity_nullable=False`` they meet where they lie, and rates are computed there. For a cohort that is still a plan, ``ReturnStudy.classified_episodes`` joins
    it to the cohort's entities before.
    """
    add = add_entity_attribute if bucketed else add_episode_attribute
    joined = add(prepared, attribute, spec)
    return classify_return(joined, spec, horizons)


def prepared_rates(
    classified: DataFrame, spec: EpisodeSpec, by: str | None = None, horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """Rates from prepared data, overall or by one of its columns."""
    dims = [by] if by else []
    return return_rates(return_flags(classified, [spec.entity, *dims], horizons), dims, horizons)


def prepared_rates_by_duration(
    classified: DataFrame,
    spec: EpisodeSpec,
    bands: Bands = DURATION_BANDS,
    horizons: tuple[int, ...] = HORIZONS,
) -> DataFrame:
    """Rates from prepared data by the length of the index episode in average months."""
    flags = return_flags(classified, [spec.entity, spec.index_start, spec.index_end], horizons)
    flags = flags.withColumn(MONTHS, average_months(F.col(spec.index_start), F.col(spec.index_end)))
    flags = flags.withColumns({BAND: band(F.col(MONTHS), bands), BAND_ORDER: band_order(F.col(MONTHS), bands)})
    return return_rates(flags, (BAND, BAND_ORDER), horizons)


def prepared_mix(classified: DataFrame, spec: EpisodeSpec, within: str, of: str) -> DataFrame:
    """Category mix on the index rows of prepared data."""
    rows = classified.where(F.col(within).isNotNull() & (F.col(spec.end) == F.col(spec.index_end)))
    weight = INDEX_ROWS if INDEX_ROWS in classified.columns else None
    return category_shares(category_counts(rows, within, of, weight), within)

"""States of parts, merged in any order, against the whole."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from recurra import (
    CohortWindow,
    EpisodeSpec,
    ReturnStudy,
    build_cohort,
    clean_episodes,
    cohort_of_state,
    entity_state,
    flags_of_state,
    merge_states,
)
from tests import brute_force as bf

SPEC = EpisodeSpec()


@pytest.fixture(scope="module")
def episodes(spark):
    raw = spark.createDataFrame(bf.random_episodes(5, 1500, hot=300), bf.SCHEMA)
    return clean_episodes(raw, SPEC).cache()


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", ["by_year", "by_year_backwards", "mixed"])
@pytest.mark.parametrize("horizons", [(1, 2, 3), (1, 4, 8)])
def test_merged_parts_equal_the_whole(spark, episodes, parts, horizons):
    part = F.year("release_date") - 2007 if parts != "mixed" else F.pmod(F.hash(*SPEC.columns), F.lit(5))
    numbers = [r[0] for r in episodes.select(part.alias("p")).distinct().orderBy("p").collect()]
    numbers = numbers[::-1] if parts == "by_year_backwards" else numbers
    states = [entity_state(episodes.where(part == n), SPEC, horizons) for n in numbers]
    state = states[0]
    for other in states[1:]:
        state = merge_states(state, other, spec=SPEC, horizons=horizons)
    whole = entity_state(episodes, SPEC, horizons)
    assert bag(state) == bag(whole) == bag(merge_states(*states, spec=SPEC, horizons=horizons))
    for year in (2009, 2010, 2012):
        window = CohortWindow.of_year(year)
        study = ReturnStudy(episodes, SPEC, window, horizons)
        for ties in ("all", "weighted", "one"):
            expected = build_cohort(episodes, SPEC, window, horizons, ties)
            found = cohort_of_state(state, SPEC, window, horizons, ties)
            assert found.columns == expected.columns and bag(found) == bag(expected)
        assert bag(flags_of_state(state, SPEC, window, horizons)) == bag(study.flags())


def test_a_state_keeps_no_day_beyond_its_reach(spark, episodes):
    state = entity_state(episodes, SPEC, (1,))
    firsts = state.groupBy("pers_id").agg(F.min("first_end_of_day").alias("first"))
    late = state.join(firsts, state.pers_id.eqNullSafe(firsts.pers_id)).where("sentence_date > date_add(first, 366)")
    assert late.count() == 0 and state.count() < entity_state(episodes, SPEC, (8,)).count()


def test_the_empty_state(spark, episodes):
    none = entity_state(episodes.limit(0), SPEC)
    assert none.count() == 0
    assert bag(merge_states(none, entity_state(episodes, SPEC), spec=SPEC)) == bag(entity_state(episodes, SPEC))

"""Cohort and return-event analytics on PySpark DataFrames."""

from recurra.operators import *  # noqa: F403
from recurra.operators import __all__ as _operators
from recurra.plans import *  # noqa: F403
from recurra.plans import __all__ as _plans
from recurra.sources import *  # noqa: F403
from recurra.sources import __all__ as _sources
from recurra.spec import DURATION_BANDS, EDUCATION_LEVELS, HORIZONS, Bands, CohortWindow, EpisodeSpec

__all__ = [
    "Bands",
    "CohortWindow",
    "DURATION_BANDS",
    "EDUCATION_LEVELS",
    "EpisodeSpec",
    "HORIZONS",
    *_operators,
    *_plans,
    *_sources,
]

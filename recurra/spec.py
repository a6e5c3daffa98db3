"""Names and parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import types as T

# Years after the index end at which returns are counted.
HORIZONS = (1, 2, 3)

# Output column names.
CASE_ID = "case_id"
RETURN_CLASS = "years_since_original_release"
FLAG_PREFIX = "recidivism_year_"
RATE_PREFIX = "prop_" + FLAG_PREFIX
RATE_VALUE = "prop_recidivism"
INDEX_ROWS = "index_rows"
MONTHS = "time_incarcerated"
BAND = "bin_time_incarcerated"
BAND_ORDER = f"{BAND}_order"

COHORT = "cohort"

# Display order of the education levels. The apostrophe that ends the last one is part of the data.
EDUCATION_LEVELS = (
    "Less than high school",
    "High school degree",
    "Some college",
    "Associate degree",
    "Bachelor's degree or higher'",
)


def check_horizons(horizons: tuple[int, ...]) -> None:
    """Classes are only right for growing numbers of years."""
    if not horizons or horizons[0] <= 0 or list(horizons) != sorted(set(horizons)):
        raise ValueError("horizons must be strictly increasing positive numbers")


@dataclass(frozen=True)
class EpisodeSpec:
    """Which columns of a table hold the entity, the interval and the attributes of an episode.

    ``entity_nullable`` makes joins on the entity match null with null. Set it to False when the key is never
    null: plain equality lets per-entity tables be joined without another shuffle.
    """

    entity: str = "pers_id"
    start: str = "sentence_date"
    end: str = "release_date"
    attributes: tuple[str, ...] = ("crime_type", "ed_level")
    entity_type: T.DataType = T.LongType()
    entity_nullable: bool = True

    @property
    def columns(self) -> list[str]:
        return [self.entity, self.start, self.end, *self.attributes]

    @property
    def key(self) -> list[str]:
        """Columns that identify one case."""
        return [self.entity, self.start, self.end]

    @property
    def index_start(self) -> str:
        return f"original_{self.start}"

    @property
    def index_end(self) -> str:
        return f"original_{self.end}"

    def horizon(self, years: int) -> str:
        return f"{self.index_end}_plus_{years}"

    def text_schema(self) -> T.StructType:
        """Schema of the raw text files: everything but the entity is read as text."""
        return T.StructType(
            [T.StructField(self.entity, self.entity_type)]
            + [T.StructField(c, T.StringType()) for c in self.columns[1:]]
        )


@dataclass(frozen=True)
class CohortWindow:
    """An entity belongs to the cohort if its first end date lies in ``[first, last]``."""

    first: date
    last: date

    @classmethod
    def of_year(cls, year: int) -> CohortWindow:
        return cls(date(year, 1, 1), date(year, 12, 31))

    def latest_return(self, horizons: tuple[int, ...]) -> date:
        """A day no counted return can start after."""
        return self.last + timedelta(days=366 * max(horizons))


@dataclass(frozen=True)
class Bands:
    """Right-closed numeric bands; the lowest break belongs to the first band, other values to none."""

    breaks: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.breaks) - 1 or list(self.breaks) != sorted(set(self.breaks)):
            raise ValueError("bands need increasing breaks and one label between each two of them")


# Bands of time served, in months.
DURATION_BANDS = Bands((0, 12, 24, 36), ("Less than a year", "1-2 years", "2-3 years"))

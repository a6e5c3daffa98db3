"""Date expressions. All of them are built-in Spark functions and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean length of a month in days, 365.25 / 12.
DAYS_PER_MONTH = 30.4375

# English month names, of which three letters are kept.
_COMPACT = r"^\d{2}[A-Za-z]{3}\d{4}$"
_LOOSE = (
    r"(?i)^\W*(\d{1,2})\W*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)tember"
    r"|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?\W*(\d{4})\W*$"
)


def parse_day(text: Column) -> Column:
    """Text such as ``29oct2008`` to a date; anything that is not a real day becomes null, never an error.

    One-digit days, separators and full month names (``5 January 2010``) are brought to the compact form first. Text
    that cannot be a date is sorted out by its shape, because a failing parse costs far more than a pattern match.
    """
    spelled = F.when(text.rlike(_COMPACT), text).when(text.rlike(_LOOSE), F.regexp_replace(text, _LOOSE, "$1$2$3"))
    return F.try_to_date(spelled, "dMMMyyyy")


def add_years(day: Column, years: int) -> Column:
    """The same calendar day ``years`` later; null where that day does not exist (29 February)."""
    moved = F.add_months(day, 12 * years)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved)


def average_months(start: Column, end: Column) -> Column:
    """Time from ``start`` to ``end`` in months of average length (not calendar months)."""
    return F.datediff(end, start) / F.lit(DAYS_PER_MONTH)

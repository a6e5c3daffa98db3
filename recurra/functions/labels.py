"""Expressions that turn values into ordered categories and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.spec import Bands


def percent_label(share: Column, decimals: int = 1) -> Column:
    """``0.1234`` as ``12.3%``, ties rounded to even; null stays null."""
    text = F.format_string(f"%.{decimals}f%%", F.bround(share * 100, decimals))
    return F.when(share.isNotNull(), text)


# Percentages are shown with at most so many decimals.
MOST_DECIMALS = 4


def automatic_percent_label(share: Column, least_gap: Column) -> Column:
    """``share`` as a percentage with as many decimals as tell the shares of a table apart.

    ``least_gap`` is the smallest difference between two different shares of the table, null if there are none. The rule:
    the fewest decimals, 0 to 4, with which one unit of the last place is not larger than that gap.
    """
    gap = least_gap * 100
    label = percent_label(share, MOST_DECIMALS)
    for decimals in reversed(range(MOST_DECIMALS)):
        enough = least_gap.isNull() | (gap >= F.lit(10.0**-decimals) * (1 - 1e-9))
        label = F.when(enough, percent_label(share, decimals)).otherwise(label)
    return label


def with_automatic_labels(table: DataFrame, share: str, name: str = "label") -> DataFrame:
    """Add percent labels to a finished report. Its rows, one per level at most, meet in one window for that."""
    gap = F.col(share) - F.lag(share).over(Window.orderBy(share))
    spaced = table.withColumn("_gap", F.when(gap > 0, gap))
    least = F.min("_gap").over(Window.partitionBy())
    return spaced.withColumn("_gap", least).withColumn(name, automatic_percent_label(F.col(share), F.col("_gap"))).drop("_gap")


def level_order(value: Column, levels: Sequence[str]) -> Column:
    """1-based position of ``value`` in ``levels``; null for null and for values that are no level."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.when(position > 0, position.cast("int"))


def level_label(value: Column, levels: Sequence[str]) -> Column:
    """``value`` itself if it is one of ``levels``, else null."""
    return F.when(value.isin(*levels), value)


def _by_band(value: Column, bands: Bands, results: Sequence) -> Column:
    chosen = F.when(value < bands.breaks[0], None)
    for upper, result in zip(bands.breaks[1:], results):
        chosen = chosen.when(value <= upper, result)
    return chosen


def band(value: Column, bands: Bands) -> Column:
    """Label of the band that holds ``value``; null outside all bands."""
    return _by_band(value, bands, bands.labels)


def band_order(value: Column, bands: Bands) -> Column:
    """1-based position of that band."""
    return _by_band(value, bands, range(1, len(bands.labels) + 1))

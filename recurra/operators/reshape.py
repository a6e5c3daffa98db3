"""Column selection helpers, long form and chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions.labels import level_label, level_order, percent_label
from recurra.spec import RATE_PREFIX, RATE_VALUE, RETURN_CLASS


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in table order."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def rates_long(rates: DataFrame) -> DataFrame:
    """One row per rate; the horizon becomes the text column ``years_since_original_release``."""
    values = columns_with_prefix(rates, RATE_PREFIX)
    ids = [c for c in rates.columns if c not in values]
    long = rates.unpivot(ids, values, RETURN_CLASS, RATE_VALUE)
    return long.withColumn(RETURN_CLASS, F.replace(F.col(RETURN_CLASS), F.lit(RATE_PREFIX), F.lit("")))


def order_levels(df: DataFrame, dim: str, levels: Sequence[str]) -> DataFrame:
    """Make ``dim`` an ordered category: unknown values become null and ``{dim}_order`` holds the position."""
    return df.withColumns(
        {dim: level_label(F.col(dim), levels), f"{dim}_order": level_order(F.col(dim), levels)}
    )


def chart_table(
    rates: DataFrame, dim: str | None = None, levels: Sequence[str] | None = None, drop_null_level: bool = False
) -> DataFrame:
    """Long form with a percent label, and the level order if ``levels`` are given."""
    if dim and drop_null_level:
        rates = rates.where(F.col(dim).isNotNull())
    if dim and levels:
        rates = order_levels(rates, dim, levels)
    return rates_long(rates).withColumn("label", percent_label(F.col(RATE_VALUE)))


def in_report_order(report: DataFrame, *columns: str) -> DataFrame:
    """Sort a finished report, nulls last. Reports have one row per level, so this sort is small."""
    return report.orderBy(*[F.asc_nulls_last(c) for c in columns])


def in_row_order(df: DataFrame, *columns: str) -> DataFrame:
    """Sort a large table, nulls last, before it is written.

    A hash of the whole row breaks ties, so that rows which agree in ``columns`` can still be divided between range
    partitions; copies of one row stay together.
    """
    tie = F.xxhash64(*df.columns)
    order = [F.asc_nulls_last(c) for c in columns]
    return df.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie")

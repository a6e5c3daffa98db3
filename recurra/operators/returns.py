"""Classification of later episodes and the rates of return that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.operators.reshape import columns_between
from recurra.spec import FLAG_PREFIX, HORIZONS, RETURN_CLASS, EpisodeSpec, check_horizons

FIRST_CLASS = "_first_class"


def return_class(spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS) -> Column:
    """Null for episodes that start on or before the index end, else the first horizon that covers the start.

    Each horizon excludes the one before and includes its own last day. Starts beyond the last horizon, or for
    which the cut points are null, get the number after the last horizon.
    """
    check_horizons(horizons)
    start, lower = F.col(spec.start), F.col(spec.index_end)
    chosen = F.when(start <= lower, F.lit(None).cast("int"))
    for n in horizons:
        upper = F.col(spec.horizon(n))
        chosen = chosen.when((start > lower) & (start <= upper), n)
        lower = upper
    return chosen.otherwise(max(horizons) + 1)


def classify_return(df: DataFrame, spec: EpisodeSpec, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add ``years_since_original_release``; needs the index end and its cut points."""
    return df.withColumn(RETURN_CLASS, return_class(spec, horizons))


def first_class(classified: DataFrame, keys: Sequence[str], value: str = RETURN_CLASS) -> DataFrame:
    """Lowest class per key. "Any episode within n years" is the same as "lowest class at most n"."""
    return classified.groupBy(*keys).agg(F.min(value).alias(FIRST_CLASS))


def flags_from_first_class(first: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Cumulative 0/1 flags per horizon; no later episode at all gives 0, not null."""
    flags = {
        f"{FLAG_PREFIX}{n}": F.coalesce(F.col(FIRST_CLASS) <= n, F.lit(False)).cast("int") for n in horizons
    }
    return first.withColumns(flags).drop(FIRST_CLASS)


def return_flags(
    classified: DataFrame, keys: Sequence[str], horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """One row per key: did any episode start within 1, 2, 3 ... years of the index end?"""
    return flags_from_first_class(first_class(classified, keys), horizons)


def return_rates(flags: DataFrame, dims: Sequence[str] = (), horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Mean of each flag, per combination of ``dims`` or over everything."""
    names = columns_between(flags, f"{FLAG_PREFIX}{horizons[0]}", f"{FLAG_PREFIX}{horizons[-1]}")
    return flags.groupBy(*dims).agg(*[F.avg(c).alias(f"prop_{c}") for c in names])


def stack_attributes(first: DataFrame, attributes: Sequence[str], whole: str) -> DataFrame:
    """Turn entity attributes into dimensions: the row of the dimension ``whole`` is repeated under each of them."""
    own = F.struct("dim", "level")
    more = [F.struct(F.lit(a).alias("dim"), F.col(a).cast("string").alias("level")) for a in attributes]
    rows = F.when(F.col("dim") == whole, F.array(own, *more)).otherwise(F.array(own))
    rest = [c for c in first.columns if c not in ("dim", "level", *attributes)]
    return first.select(*rest, F.inline(rows))

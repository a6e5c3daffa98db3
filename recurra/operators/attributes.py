"""Attributes recorded apart from the episodes, possibly several times per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.operators.skew import join_per_key
from recurra.spec import EpisodeSpec


def distinct_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(key, value).distinct()


def distinct_values(df: DataFrame, key: str, value: str, name: str = "distinct_values") -> DataFrame:
    """Number of distinct values per key; null counts as a value."""
    return distinct_pairs(df, key, value).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def consistent_attribute(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key whose records all agree; keys with conflicting records are left out.

    Null is a value of its own: all-null keys stay, a null next to a value is a conflict. Records are first reduced to the
    different pairs of key and value, which hashing does before anything is shuffled, however many records a key has. A
    key with one pair agrees; ``first`` then takes its only value.
    """
    pairs = distinct_pairs(df, key, value)
    seen = pairs.groupBy(key).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_values"))
    return seen.where("_values = 1").select(key, value)


def first_records(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first record of every key by the column ``order``, with all other columns; null keys are one key.

    ``order`` may be a struct, such as ``record_order`` of the CSV readers, and should differ from record to record. A key's
    records are reduced to one by every task before anything is shuffled, however many there are.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    if not rest:
        return df.select(*keys).distinct()
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*[c if c in keys else F.col("_first")[c].alias(c) for c in df.columns if c != order])


def consistent_records(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first record, with all columns, of every key whose records agree in ``value``.

    Null is a value of its own, as in ``consistent_attribute``. Values agree if they are all null, or if none is and the
    least is the largest, so one aggregation, combined before its shuffle, finds the keys and their first records.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    seen = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(value).alias("_known"),
        (F.min(value) == F.max(value)).alias("_same"),
    )
    agree = (F.col("_known") == 0) | ((F.col("_known") == F.col("_rows")) & F.col("_same"))
    return seen.where(agree).select(*[c if c == key else F.col("_first")[c].alias(c) for c in df.columns if c != order])


def add_distinct_values(df: DataFrame, key: str, value: str, name: str = "distinct_values") -> DataFrame:
    """Every record beside the number of distinct values of its key, null counting as a value."""
    return join_per_key(df, distinct_values(df, key, value, name), [key])


def add_entity_attribute(per_entity: DataFrame, attribute: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """Left join of an attribute table with one row per entity; entities without a record get null.

    Use it on tables of one row per entity, before episodes are joined: both sides are then partitioned by entity
    and no entity is heavy.
    """
    if not spec.entity_nullable:
        return per_entity.join(attribute, spec.entity, "left")
    other = attribute.withColumnRenamed(spec.entity, "_attribute_of")
    on = F.col(spec.entity).eqNullSafe(F.col("_attribute_of"))
    return per_entity.join(other, on, "left").drop("_attribute_of")


def add_episode_attribute(episodes: DataFrame, attribute: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """The same left join for a table of episodes, whose entities may have very many of them."""
    return join_per_key(episodes, attribute, [spec.entity], "left", spec.entity_nullable)

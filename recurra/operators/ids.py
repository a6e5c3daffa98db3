"""Dense ids over sorted keys without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.operators.skew import join_per_key
from recurra.settings import scratch_table
from recurra.spec import CASE_ID, EpisodeSpec

# monotonically_increasing_id() puts the partition number above this many bits of row position.
_POSITION_BITS = 33
_PLACE, _PART = "_place", "_part"

ROWS_IN_KEY = "_rows_in_key"


def number_keys(df: DataFrame, keys: Sequence[str], id_name: str = CASE_ID) -> DataFrame:
    """One row per distinct key: its 1-based rank in ascending key order, nulls last, and its rows (``_rows_in_key``).

    Copies of a key are first counted together (partial aggregation), so no key is heavy afterwards. The distinct
    keys are range-partitioned over the whole composite key and sorted inside each partition. Partition number and
    position are written with the keys to a table, so they stay the same whatever is computed again later
    (``remove_tables`` removes it). A key's id is its position plus the number of keys in earlier partitions.
    """
    order = [F.asc_nulls_last(k) for k in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS_IN_KEY))
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch_table(placed.withColumn(_PLACE, F.monotonically_increasing_id()))
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, _POSITION_BITS))
    # One row per partition meets in this window.
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy(_PART)) - F.col("_size")
    parts = sizes.select(_PART, before.alias("_before"))
    position = F.col(_PLACE) - F.shiftleft(F.col(_PART), _POSITION_BITS)
    numbered = placed.join(parts, _PART).withColumn(id_name, F.col("_before") + position + 1)
    return numbered.select(*keys, ROWS_IN_KEY, id_name)


def add_case_ids(df: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """Add ``case_id``: rows with the same entity, start and end (nulls included) share one id."""
    numbered = number_keys(df, spec.key).drop(ROWS_IN_KEY)
    return join_per_key(df, numbered, spec.key)

"""Equi-join of many rows with a table of facts per key, left to adaptive execution where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RIGHT = "_right_"


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = True
) -> DataFrame:
    """Join ``rows`` with ``per_key`` on ``keys`` (``how`` is "inner" or "left").

    Adaptive execution splits the rows of a heavy key over several tasks, but only if both sides of the join are fresh
    shuffles. The facts often are partitioned by the key already, which would rule that out, so they are rebalanced first:
    one more shuffle of the small side. What follows the join must not need the rows of a key together without a shuffle
    of its own, or they are not split.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    right = per_key.withColumnsRenamed({k: _RIGHT + k for k in keys}).hint("rebalance")
    pairs = [(F.col(k), F.col(_RIGHT + k)) for k in keys]
    on = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return rows.join(right, on, how).drop(*[_RIGHT + k for k in keys])

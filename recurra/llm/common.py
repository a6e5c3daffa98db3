"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from recurra.settings import scratch_table, use_local_folder

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fixed(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the folder that ``spark.checkpoint.dir`` names; lost executors cannot change it.

    Only a local session may name none; it gets a temporary folder.
    """
    use_local_folder(df.sparkSession)
    return scratch_table(df)


# What workers keep from task to task, with the modules whose functions use it.
_KEPT: list[tuple[Callable, tuple[str, ...]]] = []


def kept_by(*modules: str) -> Callable[[Callable], Callable]:
    """Decorate a function so that a worker keeps its last results until it runs a function of another module."""

    def decorate(function: Callable) -> Callable:
        cached = lru_cache(maxsize=2)(function)
        _KEPT.append((cached, modules))
        return cached

    return decorate


def release_memory() -> None:
    """Give unused memory of this process back: Spark's workers live as long as the session and run every stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Other C libraries give it back by themselves, or not at all.
        pass


def _run(function: Callable[[Batches], Batches], batches: Batches) -> Batches:
    for cached, modules in _KEPT:
        if function.__module__ not in modules:
            cached.cache_clear()
    yield from function(batches)
    release_memory()


def map_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that drops what other modules' functions left in the worker, and gives memory back at the end."""
    return df.mapInArrow(lambda batches: _run(function, batches), schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case; null has none."""
    return (text or "").encode().lower().split()


def whole_groups(batches: Batches, key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``key`` so that every group of equal keys lies in one table.

    Tables have about ``rows`` rows, or as many as the largest group.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        keys = joined.column(key).to_numpy()
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield joined.slice(0, cut)
            joined = joined.slice(cut)
        held = joined.to_batches()
        n = joined.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce links between values to one link from every value to the smallest value of its group."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        if np.array_equal(low, label[u]) and np.array_equal(low, label[v]):
            break
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]

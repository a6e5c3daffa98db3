"""Leave out rows before they are shuffled to a join that only a few of them survive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A filter has at most 2^20 words of 64 bits (8 MB) and 16 bits for each key as far as that goes; with fewer than 8 it would
# let so many rows pass that none is made.
MOST_WORDS = 1 << 20
_WORD_BITS, _BITS_PER_KEY, _LEAST_BITS_PER_KEY = 64, 16, 8


def filter_words(keys: int, most_words: int = MOST_WORDS) -> int:
    """Number of words of a filter for so many keys, 0 if it would be too full to help."""
    if keys * _LEAST_BITS_PER_KEY > most_words * _WORD_BITS:
        return 0
    words = 1
    while words < most_words and words * _WORD_BITS < keys * _BITS_PER_KEY:
        words *= 2
    return words


def _place(keys: Sequence[str], words: int) -> tuple[Column, Column]:
    """A key's word and its three bits there."""
    word = F.pmod(F.xxhash64(*keys), F.lit(words)).cast("int")
    names = ", ".join(f"`{k}`" for k in keys)
    bits = [f"shiftleft(1L, CAST(shiftright(xxhash64({names}, 1), {6 * i}) & 63 AS INT))" for i in range(3)]
    return word, F.expr(" | ".join(bits))


def key_filter(table: DataFrame, keys: Sequence[str], words: int) -> DataFrame:
    """A blocked Bloom filter over the keys of a table: one row with one array of ``words`` 64-bit words."""
    word, bits = _place(keys, words)
    empty = table.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    set_ = table.select(word.alias("word"), bits.alias("bits")).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return set_.agg(F.transform(in_order, lambda w: w["bits"]).alias("bits"))


def with_keys_of(rows: DataFrame, table: DataFrame, keys: Sequence[str], most_words: int = MOST_WORDS) -> DataFrame:
    """Rows whose key may be in ``table``: all that are, and very few others. Null keys are keys like others.

    The condition holds the key columns only, so the optimizer moves it below joins to the scan that has them, and rows
    without a partner are left out there. ``table`` is read twice now, which should be cheap: write it before. The filter
    is a value of bounded size; a table with too many keys for it leaves the rows as they are.
    """
    words = filter_words(table.count(), most_words)
    if not words:
        return rows
    word, bits = _place(keys, words)
    found = key_filter(table, keys, words).scalar()[word]
    return rows.where(found.bitwiseAND(bits) == bits)

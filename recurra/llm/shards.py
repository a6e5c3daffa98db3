"""Balanced shards by label propagation, with DataFrame functions only.

Documents that share a link key (here: equal texts) are neighbours. Every document starts in the shard that its id hashes
to. In each round the documents of a key vote, the key's strongest shard is where all of them want to go, and moves are
granted under quotas: a shard takes no more bytes than it has room for, so a share of the wishes, drawn by a hash of the
key, is granted. Keys too large for that move row by row. At last the documents without neighbours, and those that have no
room beside theirs, fill all shards to equal bytes, large ones first.

Votes are counts per key and shard; links are never listed. Positions are prefix sums over small cells, so neither a
large group nor a shard meets in one task.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import fixed

LAW = "bytes"
_LARGE_PART = 1 / 64
_CELL_ROWS = 50_000


def _unit(*columns) -> Column:
    """A number in [0, 1) by a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / (1 << 30)


def _per_shard(df: DataFrame, column: str, value: str, shards: int) -> list[int]:
    """The sum of ``value`` for each of the shards; at most one row per shard reaches the driver."""
    sums = {r[0]: r[1] for r in df.groupBy(column).agg(F.sum(value)).collect()}
    return [int(sums.get(s) or 0) for s in range(shards)]


def _wishes(rows: DataFrame) -> DataFrame:
    """(key, shard, to, n, bytes) for every part of a key that lies elsewhere than the key's strongest shard."""
    parts = rows.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    strongest = Window.partitionBy("key").orderBy(F.desc("n"), F.xxhash64("key", "shard"))
    return parts.withColumn("to", F.first("shard").over(strongest)).where("to != shard")


def _propagate(rows: DataFrame, loads: list[int], quota: float, shards: int, number: int) -> tuple[DataFrame, bool]:
    """One round: the rows with their new shards, and whether any wished to move."""
    wishes = fixed(_wishes(rows))
    inflow = _per_shard(wishes, "to", "bytes", shards)
    outflow = _per_shard(wishes, "shard", "bytes", shards)
    if not sum(inflow):
        return rows, False
    room = [max(0.0, quota - load + out) for load, out in zip(loads, outflow)]
    chance = F.array(*[F.lit(min(1.0, r / i) if i else 0.0) for r, i in zip(room, inflow)])
    large = F.col("bytes") > quota * _LARGE_PART
    granted = wishes.select("key", "shard", "to", large.alias("large"), F.get(chance, F.col("to")).alias("chance"))
    drawn = F.when(F.col("large"), _unit("row", F.lit(number))).otherwise(_unit("key", F.lit(number)))
    moved = F.when(drawn < F.col("chance"), F.col("to"))
    joined = rows.join(granted, ["key", "shard"], "left").withColumn("shard", F.coalesce(moved, "shard"))
    return fixed(joined.select(*rows.columns)), True


def _running(rows: DataFrame, group: list[str], cell: list[str], order: list, value) -> DataFrame:
    """Add ``ahead``: the sum of ``value`` over the rows before, group by group in the order of the cells."""
    sums = rows.groupBy(*group, *cell).agg(F.sum(value).alias("sum"))
    first = F.sum("sum").over(Window.partitionBy(*group).orderBy(*order)) - F.col("sum")
    sums = sums.select(*group, *cell, first.alias("first"))
    within = F.sum(value).over(Window.partitionBy(*group, *cell).orderBy("row")) - value
    placed = rows.withColumn("within", within).join(sums, [*group, *cell])
    return placed.withColumn("ahead", F.col("first") + F.col("within")).drop("first", "within")


def _fill(rows: DataFrame, quotas: list[int], buckets: int) -> DataFrame:
    """Fill all shards to their quotas: linked rows stay as far as quotas allow, all other rows take the room.

    Rows without a place go class by class from the largest to the smallest. A class is laid out as one row of bytes and
    cut in proportion to the room of the shards; later classes make up for what its cuts were off.
    """
    shards = len(quotas)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("class", F.floor(F.log2("size") / 2).cast("int"))
    linked = _running(rows.where("linked"), ["shard"], ["bucket"], ["bucket"], F.col("size"))
    quota = F.get(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("shard"))
    linked = fixed(linked.withColumn("stays", F.col("ahead") + F.col("size") <= quota).drop("ahead"))
    stay = linked.where("stays").drop("stays", "class", "bucket")
    free = linked.where("not stays").drop("stays").unionByName(rows.where("not linked"))
    free = fixed(_running(free, ["class"], ["bucket"], ["bucket"], F.col("size")))
    room = [max(0, q - k) for q, k in zip(quotas, _per_shard(stay, "shard", "size", shards))]
    totals = {r[0]: r[1] for r in free.groupBy("class").agg(F.sum("size")).collect()}
    middle = F.col("ahead") + F.col("size") / 2
    choices = None
    for number in sorted(totals, reverse=True):
        open_bytes = sum(room) or 1
        edges = [e * totals[number] / open_bytes for e in accumulate(room)]
        to = F.lit(shards - 1)
        for s in reversed(range(shards - 1)):
            to = F.when(middle < edges[s], F.lit(s)).otherwise(to)
        chosen = F.col("class") == number
        own = _per_shard(free.where(chosen).withColumn("to", to), "to", "size", shards)
        room = [max(0, r - o) for r, o in zip(room, own)]
        choices = F.when(chosen, to) if choices is None else choices.when(chosen, to)
    if choices is not None:
        free = free.withColumn("shard", choices.cast("int"))
    return fixed(stay.unionByName(free.drop("ahead", "class", "bucket")))


def balanced_shards(
    docs: DataFrame, shards: int = 8, rounds: int = 5, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the number of UTF-8 bytes of the text (null: none) plus 1. Bytes per shard differ by a small document or so;
    slots count the rows of a shard from 0 without gaps. Equal texts, null texts among them, are neighbours and share a
    shard as far as quotas allow. Null or repeated ids and repeated rows are placed like others; other columns are
    ignored; an empty table gives no rows.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(words) + 1).cast("long").alias("size"),
        F.crc32(words.cast("binary")).alias("crc"),
        F.coalesce(F.unhex(F.md5(F.col(text))), F.lit("null").cast("binary")).alias("key"),
    )
    # The number of a row and its shard are fixed by this table.
    rows = fixed(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int"))
    copies = rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("linked"))
    rows = rows.join(copies, "key", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    rows = fixed(rows)
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    linked, alone = rows.where("linked"), rows.where("not linked")
    for number in range(rounds):
        # Documents without neighbours make room at no cost, so quotas count linked documents only.
        loads = _per_shard(linked, "shard", "size", shards)
        linked, busy = _propagate(linked, loads, (total or 0) / shards, shards, number)
        if not busy:
            break
    quotas = [(total or 0) * (s + 1) // shards - (total or 0) * s // shards for s in range(shards)]
    buckets = max(1, ceil(n / shards / _CELL_ROWS))
    rows = _fill(linked.unionByName(alone), quotas, 8 * buckets)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(8 * buckets)).cast("int"))
    placed = _running(rows, ["shard"], ["bucket"], ["bucket"], F.lit(1).cast("long"))
    return placed.select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        F.col("ahead").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

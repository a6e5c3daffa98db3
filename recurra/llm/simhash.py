"""Near-duplicates by SimHash fingerprints, found with anchor points of a covering code.

A covering code is a set of anchors such that every fingerprint lies within its radius of some anchor. The code used here
is a product: the 64 bits are cut into parts so that two fingerprints within the threshold differ in at most one bit of
some part (one part more than half the threshold). A part's code is the perfect Hamming code on its first 15 bits (radius
1) times all values of its other bits (radius 0). A fingerprint is at home with the anchor that it decodes to, and is
replicated to every anchor within covering radius plus the part's share of the threshold that a fingerprint one bit away
may call home: about 14 of 131,072 in a part of 21 bits. Each anchor compares those at home with the replicas.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import Batches, fixed, kept_by, map_arrow, spanning_forest, whole_groups, words
from recurra.llm.graph import components

BITS = 64
_CODE_BITS = 15
_SEED = 42
_AT_ONCE = 1 << 20
# An anchor with more rows than this is compared in blocks of that size; a list of so many such anchors is broadcast.
BLOCK_ROWS = 20_000
BROADCAST_ANCHORS = 100_000


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash over the word shingles of a text, repeats included; 0 without any word."""
    tokens = words(text)
    if not tokens:
        return 0
    size = min(shingle, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = b" ".join(tokens)
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = len(tokens) - size + 1
    ends = (starts + lengths)[size - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        spans = zip(starts[at : min(n, at + _AT_ONCE)].tolist(), ends[at : at + _AT_ONCE].tolist())
        hashes = np.array([digest(joined[s:e], _SEED) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """(id, fingerprint) for every row; the fingerprint is a long with the same 64 bits."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            longs = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs)], names=[id_column, "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, text), run, f"`{id_column}` {kind}, fingerprint long")


def parts_of(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the parts: fingerprints within ``distance`` differ in one bit at most of some part."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


@kept_by("recurra.llm.simhash")
def _decoded() -> np.ndarray:
    """The nearest codeword of the Hamming code of length 15 for each of its 32,768 words."""
    values = np.arange(1 << _CODE_BITS, dtype=np.int64)
    syndrome = np.zeros_like(values)
    for bit in range(_CODE_BITS):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    return np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)


def _home(values: np.ndarray, width: int) -> np.ndarray:
    if width < _CODE_BITS:
        return values
    low = (1 << _CODE_BITS) - 1
    return (values & ~np.int64(low)) | _decoded()[values & low]


def anchors(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, at home) for every anchor that a fingerprint has to meet."""
    found = []
    for number, (first, width) in enumerate(parts_of(distance)):
        whole = prints.view(np.uint64) >> np.uint64(first)
        part = whole if width == BITS else whole & np.uint64((1 << width) - 1)
        part = part.view(np.int64)
        if distance == 0:
            near = part[:, None]
        else:
            flips = np.concatenate([[0], np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))])
            near = np.sort(_home(part[:, None] ^ flips, width), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, place = np.nonzero(new)
        code = near[row, place]
        home = code == (part if distance == 0 else _home(part, width))[row]
        # The number of the part joins the key; a part is narrower than 64 bits unless there is only one.
        found.append((code * len(parts_of(distance)) + number, row, home))
    return tuple(np.concatenate(x) for x in zip(*found))


def _replicas(prints: DataFrame, distance: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 5_000):
                some = own[at : at + 5_000]
                key, row, home = anchors(some, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(some[row]), pa.array(home)], names=["anchor", "fingerprint", "home"]
                )

    return map_arrow(prints, run, "anchor long, fingerprint long, home boolean")


def _blocks(replicas: DataFrame, block_rows: int) -> DataFrame:
    """Add ``block``, ``left`` and ``right``: within a block every left row is compared with every right row.

    Anchors with many rows are cut: in block (i, j) the rows at home of cut i are left and the rows of cut j are right. Of
    two rows at home in different cuts the later is right once, so that they meet once.
    """
    light = F.struct(F.col("anchor").alias("block"), F.col("home").alias("left"), F.lit(True).alias("right"))
    heavy = replicas.groupBy("anchor").count().where(F.col("count") > block_rows)
    heavy = fixed(heavy.select("anchor", F.ceil(F.col("count") / block_rows).cast("int").alias("cuts")))
    n = heavy.count()
    if not n:
        return replicas.select("anchor", "fingerprint", light.alias("met")).select("anchor", "fingerprint", "met.*")
    heavy = F.broadcast(heavy) if n <= BROADCAST_ANCHORS else heavy
    cut = replicas.join(heavy, "anchor", "left")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")).cast("int"))

    def met(i: Column, j: Column, left: bool) -> Column:
        block = F.xxhash64("anchor", i, j)
        return F.struct(block.alias("block"), F.lit(left).alias("left"), F.lit(not left).alias("right"))

    last = F.col("cuts") - 1
    lefts = F.transform(F.sequence(F.lit(0), last), lambda j: met(F.col("own"), j, True))
    until = F.when(F.col("home"), F.col("own")).otherwise(last)
    rights = F.transform(F.sequence(F.lit(0), until), lambda i: met(i, F.col("own"), False))
    roles = F.when(F.col("cuts").isNull(), F.array(light)).when(F.col("home"), F.concat(lefts, rights)).otherwise(rights)
    return cut.select("anchor", "fingerprint", F.explode(roles).alias("met")).select("anchor", "fingerprint", "met.*")


def _compare(distance: int):
    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block, anchor = group.column("block").to_numpy(), group.column("anchor").to_numpy()
        prints = group.column("fingerprint").to_numpy()
        lefts, rights = (group.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])
        start = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        meets = np.add.reduceat(lefts.astype(np.int64), start)[number] * rights
        pairs = np.cumsum(meets)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(block):
            done = pairs[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(pairs, done + 4 * _AT_ONCE, "right")))
            n = meets[at:to]
            row = np.repeat(np.arange(at, to), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x, y = prints[start[number[row]] + within], prints[row]
            near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
            a, b = spanning_forest(x[near], y[near])
            left.append(a)
            right.append(b)
            at = to
        return spanning_forest(np.concatenate(left), np.concatenate(right))

    def run(batches: Batches) -> Batches:
        for group in whole_groups(batches, "block"):
            a, b = links(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def link_fingerprints(prints: DataFrame, distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``distance`` of each other, not one row per pair.

    Each anchor returns a spanning forest of its links, so a large group of near-copies does not grow quadratically.
    """
    replicas = _blocks(_replicas(prints, distance), block_rows)
    met = replicas.repartition("block").sortWithinPartitions("block", "anchor", F.desc("left"))
    return map_arrow(met, _compare(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row (id, fingerprint, component_id) for every row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``distance`` bits; component_id is the smallest id reachable.
    Fingerprints are taken over ``shingle`` words (fewer words: all of them). Null, empty and blank texts have
    fingerprint 0 and are linked like any other; a null id has the component of its fingerprint but never names one
    unless all ids there are null. Repeated rows are returned as often as given; other columns are ignored. An empty table
    gives an empty result.
    """
    if not 0 <= distance < BITS // 2:
        raise ValueError("distance must be between 0 and 31")
    rows = fixed(fingerprints(docs, id_column, text, shingle))
    prints = fixed(rows.groupBy("fingerprint").agg(F.min(id_column).alias("least")))
    linked = components(link_fingerprints(prints.select("fingerprint"), distance, block_rows))
    linked = linked.select(F.col("node").alias("fingerprint"), "component")
    roots = prints.join(linked, "fingerprint", "left")
    roots = roots.withColumn("component", F.coalesce("component", "fingerprint"))
    names = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    named = fixed(roots.join(fixed(names), "component").select("fingerprint", "component_id"))
    joined = rows.join(named, "fingerprint")
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return joined.select(id_column, shown.alias("fingerprint"), "component_id")


def without_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, and of these the smallest text hash.

    A row is known by its id and the hash of its text, so rows that share an id, or have none, are told apart by their texts;
    null ids come after all others. Of rows equal in both one stays. Null and empty texts are a group, as in
    ``near_duplicates``. Columns stay as they are; an empty table gives an empty result.
    """
    hashed = F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))
    row = F.struct(F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"), hashed.alias("hash"))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    groups = near_duplicates(rows, "row", "text", shingle, distance)
    counted = fixed(groups.groupBy("row").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("copies")))

    def named(which: DataFrame) -> DataFrame:
        return which.select(F.col("row.id").alias("_id"), F.col("row.hash").alias("_hash"))

    same = F.col(id_column).eqNullSafe(F.col("_id")) & (hashed == F.col("_hash"))
    kept = docs.join(named(counted.where("row != first")), same, "left_anti")
    again = fixed(named(counted.where("row = first and copies > 1")))
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumn("_hash", hashed).dropDuplicates([id_column, "_hash"])
    return kept.join(again, same, "left_anti").unionByName(once.drop("_hash"))

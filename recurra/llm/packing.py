"""Packing of documents into windows of tokens by deficit round-robin over the queues of their sources.

Each source is a queue of packets: documents cut into pieces of at most ``packet`` tokens. In every round a queue earns a
quantum, the window size times the target share of its source, and sends packets as long as its deficit counter covers
them; what is left is carried to the next round. As a queue stays backlogged until it is empty, the counter needs no
loop: a packet that starts after ``a`` tokens of its queue leaves in round floor((a + c * n) / quantum), where n is its
length and c in [0, 1) an initial credit by a hash of the source, so that many small sources don't all send at once. At
any time a queue is less than one packet away from its target. Rounds are laid end to end and cut into windows, so each
window holds the target mix, nothing is padded but the last window, and the counters cross windows and partitions: they
are prefix sums, which Spark computes in two levels.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import Batches, fixed, map_arrow
from recurra.llm.encode import encoder

_ROUNDS = 256
_BLOCKS = 4096
# The counters of so many queues and batches are broadcast; more are joined by shuffling.
BROADCAST_COUNTERS = 500_000
_PACKET = "batch long, source string, doc_id long, start long, before long, n long, doc_tokens long, ids binary"


def _id_type(tokenizer: str, end_id: int) -> np.dtype:
    """Two bytes per id where the vocabulary allows it: ids are what moves between machines."""
    return np.dtype("<u2" if max(encoder(tokenizer, end_id).size, end_id + 1) <= 1 << 16 else "<u4")


def _packets(docs: DataFrame, tokenizer: str, end_id: int, packet: int, kind: np.dtype) -> DataFrame:
    """Packets with the tokens of the same source before them in the same batch of rows."""
    width = kind.itemsize

    def run(batches: Batches) -> Batches:
        encode = encoder(tokenizer, end_id).encode
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids_of, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            queue: dict[str | None, int] = {}
            number += 1
            for first, edges, ids in encode(batch.column(1)):
                rows: list[tuple] = []
                raw = ids.astype(kind).tobytes()
                edges = edges.tolist()
                for doc, source, a, b in zip(ids_of[first:], sources[first:], edges, edges[1:]):
                    before = queue.get(source, 0)
                    queue[source] = before + b - a
                    for at in range(a, b, packet):
                        to = min(b, at + packet)
                        rows.append((source, doc, at - a, before + at - a, to - at, b - a, raw[width * at : width * to]))
                columns = list(zip(*rows))
                types = [pa.string(), *[pa.int64()] * 5, pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                names = ["source", "doc_id", "start", "before", "n", "doc_tokens", "ids"]
                same = pa.array(np.full(len(rows), number))
                yield pa.RecordBatch.from_arrays([same, *arrays], names=["batch", *names])

    return map_arrow(docs, run, _PACKET)


def _quanta(packets: DataFrame, window: int, targets: Mapping[str, float] | None) -> DataFrame:
    """(source, batch, ahead, quantum): tokens of the source in earlier batches, and what it earns per round."""
    sums = packets.groupBy("source", "batch").agg(F.sum("n").alias("n"))
    per_source = Window.partitionBy("source")
    ahead = F.sum("n").over(per_source.orderBy("batch")) - F.col("n")
    sums = sums.withColumns({"ahead": ahead, "own": F.sum("n").over(per_source)})
    total = packets.agg(F.sum("n")).first()[0] or 1
    share = F.col("own") / total
    if targets:
        whole = float(sum(targets.values()))
        if whole <= 0 or min(targets.values()) <= 0:
            raise ValueError("targets must be positive")
        wanted = F.create_map(*[F.lit(x) for s, t in targets.items() for x in (s, t / whole)])
        share = F.coalesce(F.element_at(wanted, F.col("source")), share)
    return sums.select("source", "batch", "ahead", (share * window).alias("quantum"))


def _widen(pieces: DataFrame, kind: np.dtype) -> DataFrame:
    """Ids with four bytes each."""
    if kind.itemsize == 4:
        return pieces

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("ids")
            _, offsets, data = ids.buffers()
            edges = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
            own = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(kind).astype("<u4") if len(ids) else b""
            edges = ((edges - edges[0]) * 2).astype(np.int32)
            wide = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edges), pa.py_buffer(own)])
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", wide)

    return map_arrow(pieces, run, pieces.schema)


def _first_places(blocks: DataFrame) -> DataFrame:
    """(block, first): the ids in all blocks before. One row per ``_BLOCKS`` blocks meets in one task, the others don't."""
    grouped = blocks.withColumn("group", F.floor(F.col("block") / _BLOCKS))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("block")) - F.col("n")
    totals = grouped.groupBy("group").agg(F.sum("n").alias("all"))
    outside = totals.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("outside"))
    placed = grouped.withColumn("inside", inside).join(outside, "group")
    return placed.select("block", (F.col("inside") + F.col("outside")).alias("first"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    targets: Mapping[str, float] | None = None,
    packet: int = 512,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece of a document: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its sequence; ``ids`` is binary
    (little-endian unsigned 32-bit numbers). All sequences but the last have exactly ``window`` ids. ``targets`` gives
    shares of tokens by source; sources it doesn't name, and all sources without it, take their share of the corpus.
    When a queue is empty the others share its room in proportion. Null and empty texts have the end id alone; a null
    source is a queue of its own; null or repeated ids are packed like others. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")
    )
    kind = _id_type(tokenizer, end_id)
    packets = fixed(_packets(rows, tokenizer, end_id, packet, kind))
    quanta = fixed(_quanta(packets, window, targets))
    few = quanta.count() <= BROADCAST_COUNTERS
    quanta = quanta.withColumnsRenamed({"source": "q_source", "batch": "q_batch"})
    quanta = F.broadcast(quanta) if few else quanta
    met = packets.join(quanta, (F.col("batch") == F.col("q_batch")) & F.col("source").eqNullSafe(F.col("q_source")))
    credit = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(1 << 20)) / (1 << 20)
    queued = F.col("ahead") + F.col("before")
    turn = F.floor((queued + credit * F.col("n")) / F.col("quantum"))
    met = met.withColumns({"queued": queued, "turn": turn, "block": F.floor(turn / _ROUNDS)})
    met = met.drop("q_source", "q_batch", "ahead", "quantum", "batch", "before")

    order = Window.partitionBy("block").orderBy("turn", "source", "queued")
    placed = met.withColumn("place", F.sum("n").over(order) - F.col("n"))
    slim = packets.drop("ids").join(
        quanta, (F.col("batch") == F.col("q_batch")) & F.col("source").eqNullSafe(F.col("q_source"))
    )
    blocks = slim.groupBy(F.floor(turn / _ROUNDS).alias("block")).agg(F.sum("n").alias("n"))
    blocks = fixed(_first_places(fixed(blocks)))
    placed = placed.join(blocks, "block").withColumn("place", F.col("place") + F.col("first"))

    size = F.lit(window).cast("long")
    cuts = F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("n") - 1) / size))
    pieces = placed.withColumn("sequence_id", F.explode(cuts))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * size)
    pieces = pieces.withColumn("skip", begin - F.col("place"))
    length = F.least(F.col("n") - F.col("skip"), (F.col("sequence_id") + 1) * size - begin)
    width = kind.itemsize
    pieces = pieces.select(
        "doc_id",
        "source",
        (F.col("start") + F.col("skip")).alias("start"),
        length.alias("length"),
        "doc_tokens",
        "sequence_id",
        (begin - F.col("sequence_id") * size).alias("offset"),
        F.substring("ids", (F.col("skip") * width + 1).cast("int"), (length * width).cast("int")).alias("ids"),
    )
    return _widen(pieces, kind)

"""Repeated passages by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes falls below a bound, so cuts follow the content: an insertion changes
the chunks around it and no others. Chunks have a least and a greatest size and never split a character. Chunks are
deduplicated by digest with one aggregation (smallest and largest document of each digest). A run is made of chunks in a
row that all repeat, whatever the first document of each; a run of enough words is reported, so a single common phrase is
not. Parts of a run that share the first document are told apart if they have enough words, other parts are joined. A run
needs many equal digests side by side, so 64-bit digests are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import Batches, fixed, map_arrow

LEAST, SPACING, MOST = 16, 16, 80
_WINDOW = 16
_BLOCK = 4 << 20
_SLICE = 2 << 20
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b])) & 0xFFFF for b in range(256)], np.uint16)
_BOUND = np.uint16(65536 // SPACING)
_TEXT = ("doc_id", "text_hash")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

CHUNK = "doc_id long, text_hash long, ordinal int, start int, size int, words int, digest long"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[byte] modulo 2**16 after each byte; the last 16 bytes decide it."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint16(step)
        h = shifted
    return h


def _candidates(data: np.ndarray) -> np.ndarray:
    """Positions before which the content allows a cut."""
    found = []
    for at in range(0, len(data), _BLOCK):
        before = max(0, at - _WINDOW + 1)
        low = gear(data[before : at + _BLOCK])[at - before :] < _BOUND
        found.append(np.flatnonzero(low) + at + 1)
    where = np.concatenate(found) if found else np.empty(0, np.int64)
    where = where[where < len(data)]
    return where[(data[where] & 0xC0) != 0x80]


def cut_points(data: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """For each text data[edges[i]:edges[i + 1]] the ends of its chunks, as positions in ``data``."""
    inside = (data & 0xC0) == 0x80
    candidates = _candidates(data)
    bounds = np.searchsorted(candidates, edges, "right").tolist()
    candidates = candidates.tolist()
    made = []
    edges = edges.tolist()
    for begin, end, low, high in zip(edges, edges[1:], bounds, bounds[1:]):
        cuts: list[int] = []
        at = begin
        for place in candidates[low:high]:
            if place >= end:
                break
            while place - at > MOST:
                at += MOST
                while inside[at]:
                    at -= 1
                cuts.append(at)
            if place - at >= LEAST:
                at = place
                cuts.append(at)
        while end - at > MOST:
            at += MOST
            while inside[at]:
                at -= 1
            cuts.append(at)
        if end > at:
            cuts.append(end)
        made.append(cuts)
    return made


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first text, bytes, edges) for about ``_SLICE`` bytes of texts at a time."""
    _, offsets, buffer = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _SLICE, "right")) - 1)
        size = int(edges[to] - edges[at])
        raw = buffer.slice(int(edges[at]), size).to_pybytes() if size else b""
        yield at, raw, edges[at : to + 1] - edges[at]
        at = to


def _chunk_rows(batches: Batches) -> Batches:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, raw, edges in _text_slices(batch.column(2)):
            data = np.frombuffer(raw, np.uint8)
            space = _SPACE[data]
            starts = ~space
            starts[1:] &= space[:-1]
            first_byte = edges[:-1][np.diff(edges) > 0]
            starts[first_byte] = ~space[first_byte]
            word_starts = np.flatnonzero(starts)
            cuts = cut_points(data, edges)
            counts = np.array([len(c) for c in cuts])
            n = int(counts.sum())
            ends = np.fromiter((e for c in cuts for e in c), np.int64, n)
            first = np.cumsum(counts) - counts
            begins = np.empty(n, np.int64)
            begins[1:] = ends[:-1]
            begins[first[counts > 0]] = edges[:-1][counts > 0]
            made = [digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, begins)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": np.repeat(ids[at : at + len(cuts)], counts),
                    "text_hash": np.repeat(hashes[at : at + len(cuts)], counts),
                    "ordinal": (np.arange(n) - np.repeat(first, counts)).astype(np.int32),
                    "start": (begins - np.repeat(edges[:-1], counts)).astype(np.int32),
                    "size": (ends - begins).astype(np.int32),
                    "words": words.astype(np.int32),
                    "digest": np.array(made, np.uint64).view(np.int64),
                }
            )
        pa.default_memory_pool().release_unused()


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``CHUNK``) per chunk of every text; start and size count UTF-8 bytes, words those that begin in it.

    Rows without id and empty texts have no chunk.
    """
    named = [F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    rows = docs.select(*named, F.col(text).alias("text"))
    return map_arrow(rows.where("doc_id is not null and text != ''"), _chunk_rows, CHUNK)


def repeated_passages(
    docs: DataFrame, min_words: int = 30, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (doc_id, text_hash, start, end, words, first_doc_id) per passage that other documents hold too.

    start and end are UTF-8 byte positions. Every run of repeated chunks with ``min_words`` is reported, in one or more rows.
    Parts of it that share their first document and have ``min_words`` are rows with that document as first_doc_id, which
    may be the document itself. Chunks beside them that earlier documents hold are joined whatever these are: with
    ``min_words`` to rows with the smallest of them as first_doc_id, shorter ones to the row before them, or else after them,
    that an earlier document holds too. What remains is held by no earlier document in ``min_words``; rows that name the
    document itself show it where it has as many.
    A passage of n words is seen without the few words up to the first and after the last cut in it.
    Documents that repeat nothing have no row. Texts are known by id and text_hash, the XXH64 of the text: each text under an
    id has rows of its own, equal rows are counted once, and texts with equal ids repeat nothing from each other. Rows without
    id, null and empty texts have no passage. Other columns are ignored; an empty table gives no rows.
    """
    rows = fixed(chunks(docs, id_column, text))
    ends = rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    repeated = ends.where("first_doc_id != last_doc_id").select(F.col("digest").alias("known"), "first_doc_id")
    found = rows.join(fixed(repeated), F.col("digest") == F.col("known"))
    # Copies of a row are counted once, before they meet: one row may stand for a large part of the table.
    names = ["start", "size", "words", "first_doc_id"]
    found = found.groupBy(*_TEXT, "ordinal").agg(*[F.first(n).alias(n) for n in names])

    def island(*keys: str) -> Column:
        return F.col("ordinal") - F.dense_rank().over(Window.partitionBy(*_TEXT, *keys).orderBy("ordinal"))

    def enough(*keys: str) -> Column:
        return F.sum("words").over(Window.partitionBy(*_TEXT, *keys)) >= min_words

    runs = found.withColumn("run", island()).withColumn("long", enough("run")).where("long")
    parts = runs.withColumn("part", island("first_doc_id")).withColumn("one", enough("first_doc_id", "part"))
    parts = parts.withColumn("early", F.col("first_doc_id") < F.col("doc_id"))
    parts = parts.withColumn("stretch", island("one", "early"))
    parts = parts.withColumn("joined", ~F.col("one") & F.col("early") & enough("one", "early", "stretch"))
    own = F.struct(F.lit(0).alias("how"), F.col("first_doc_id").alias("of"))
    shared = F.struct(F.lit(1).alias("how"), F.lit(None).cast("long").alias("of"))
    parts = parts.withColumn("row", F.when(F.col("one"), own).when(F.col("joined"), shared))
    # What is too short for a row of its own belongs to the one beside it in the same stretch of earlier documents' chunks.
    parts = parts.withColumn("reach", island("early"))
    stretch = Window.partitionBy(*_TEXT, "early", "reach").orderBy("ordinal")
    before = F.last("row", ignorenulls=True).over(stretch.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("row", ignorenulls=True).over(stretch.rowsBetween(0, Window.unboundedFollowing))
    parts = parts.withColumn("row", F.when(F.col("early"), F.coalesce(before, after)).otherwise(F.col("row")))
    pieces = parts.withColumn("piece", island("row")).groupBy(*_TEXT, "row", "piece")
    passages = pieces.agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("size")).alias("end"),
        F.sum("words").alias("words"),
        F.min("first_doc_id").alias("first"),
    )
    first = F.when(F.col("row").isNull(), F.col("doc_id")).when(F.col("row.how") == 0, F.col("row.of")).otherwise(F.col("first"))
    passages = passages.where(F.col("row").isNotNull() | (F.col("words") >= min_words))
    return passages.select(*_TEXT, "start", "end", "words", first.alias("first_doc_id"))


def without_repeats(
    docs: DataFrame, passages: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; columns, and rows without such, stay as they are.

    A passage is cut out of the texts it was found in, known by id and hash, and of all their copies.
    """
    later = passages.where("doc_id != first_doc_id").groupBy(*_TEXT)
    spans = later.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    same = (F.col(id_column) == F.col("_doc")) & (F.xxhash64(text) == F.col("_hash"))
    met = docs.join(spans, same, "left").drop("_doc", "_hash")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(value, own):
            if own is None:
                return value
            raw, kept, at = value.encode(), [], 0
            for span in own:
                kept.append(raw[at : max(at, span["start"])])
                at = max(at, span["end"])
            return b"".join([*kept, raw[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    cleaned = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("_spans")))
    return met.withColumn(text, cleaned).select(*docs.columns)

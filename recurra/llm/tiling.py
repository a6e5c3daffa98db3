"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of five words are compared. Tiling by running Karp-Rabin finds matches of
words between an item and the places of the document around the seeds: long windows first, each scan hashes the windows of
words that are not covered yet, and the longest matches that don't overlap are marked as tiles. A document holds an item if
tiles cover enough of its words, in whatever order they stand.

Items travel to the documents in blocks of a bounded number of words, so any benchmark fits: the documents are read once
per block, and no seed of a document is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import Batches, map_arrow

SEED_WORDS = 5
MIN_TILE = 3
COVERAGE = 0.8
_FIRST_SCAN = 20
# Benchmark characters that are collected and broadcast at once.
BLOCK_CHARS = 16_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")

LEAK = "doc_id long, text_hash long, item_id long, matched int, item_words int, coverage double"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = ids.astype(np.uint64) + np.uint64(1)
    hashes = np.zeros(n, np.uint64)
    for i in range(size):
        hashes = hashes * _BASE + mixed[i : i + n]
    return hashes


def _scan(pattern: np.ndarray, text: np.ndarray, free_p, free_t, size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least ``size`` free words as (length, place in pattern, place in text), and the longest."""

    def open_windows(free: np.ndarray) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return taken[size:] == taken[:-size] if len(free) >= size else np.empty(0, bool)

    in_pattern, in_text = open_windows(free_p), open_windows(free_t)
    hashes = _windows(text, size)
    known = np.unique(_windows(pattern, size)[in_pattern])
    places = np.flatnonzero(in_text & np.isin(hashes, known))
    at = defaultdict(list)
    for place, value in zip(places.tolist(), hashes[places].tolist()):
        at[value].append(place)
    matches, longest = [], 0
    ours = _windows(pattern, size).tolist()
    for p in np.flatnonzero(in_pattern).tolist():
        for t in at.get(ours[p], ()):
            # A match that could begin one word earlier is found there.
            if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue
            most = min(len(pattern) - p, len(text) - t)
            same = (pattern[p : p + most] == text[t : t + most]) & free_p[p : p + most] & free_t[t : t + most]
            length = most if same.all() else int(np.argmin(same))
            if length >= size:
                matches.append((length, p, t))
                longest = max(longest, length)
    return longest, matches


def tile(pattern: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in pattern, place in text, length); ids below 0 match nothing."""
    free_p, free_t = pattern >= 0, text >= 0
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(_FIRST_SCAN, len(pattern)))
    while True:
        longest, matches = _scan(pattern, text, free_p, free_t, size)
        if longest > 2 * size:
            size = longest
            continue
        pending = defaultdict(list)
        for length, p, t in matches:
            pending[length].append((p, t))
        for length in range(longest, size - 1, -1):
            for p, t in sorted(pending.pop(length, ())):
                whole = free_p[p : p + length] & free_t[t : t + length]
                if whole.all():
                    free_p[p : p + length] = False
                    free_t[t : t + length] = False
                    tiles.append((p, t, length))
                    continue
                # What other tiles left of the match waits for its turn.
                edges = np.flatnonzero(np.diff(np.concatenate([[0], whole.astype(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if b - a >= size:
                        pending[b - a].append((p + a, t + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


@dataclass
class Block:
    """Items of the benchmark with the seeds that lead to them."""

    items: dict[int, np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    leads: list[list[int]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], least: int) -> Block:
        vocabulary: dict[str, int] = {}
        items, leads = {}, defaultdict(list)
        for item, text in rows:
            own = tokens(text)
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64)
            if not len(ids):
                continue
            items[item] = ids
            for seed in np.unique(_windows(ids, min(least, len(ids)))).tolist():
                leads[seed].append(item)
        seeds = np.array(sorted(leads), np.uint64)
        return cls(items, vocabulary, seeds, [leads[s] for s in seeds.tolist()])

    def places(self, ids: np.ndarray, sizes: list[int]) -> dict[int, list[int]]:
        """For each item with a seed in a document, the places of its seeds."""
        found: dict[int, list[int]] = defaultdict(list)
        if not len(self.seeds):
            return found
        for size in sizes:
            if len(ids) < size:
                continue
            outside = np.concatenate([[0], np.cumsum(ids < 0)])
            inside = np.flatnonzero(outside[size:] == outside[:-size])
            if not len(inside):
                continue
            hashes = _windows(ids, size)[inside]
            at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
            hit = self.seeds[at] == hashes
            for place, seed in zip(inside[hit].tolist(), at[hit].tolist()):
                for item in self.leads[seed]:
                    found[item].append(place)
        return found


def _near(places: list[int], reach: int, n: int) -> list[tuple[int, int]]:
    """Stretches of a document within ``reach`` words of the places."""
    out: list[list[int]] = []
    for place in sorted(places):
        a, b = max(0, place - reach), min(n, place + 2 * reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _holds(block: Block, seed_words: int, min_tile: int, coverage: float):
    # Items shorter than a seed are seeds as a whole.
    sizes = sorted({min(seed_words, len(ids)) for ids in block.items.values()})

    def run(batches: Batches) -> Batches:
        known = block.vocabulary.get
        for batch in batches:
            rows = []
            for doc, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = tokens(text)
                ids = np.fromiter((known(w, -1) for w in own), np.int64, len(own))
                for item, places in block.places(ids, sizes).items():
                    pattern = block.items[item]
                    gap = np.array([-1], np.int64)
                    stretches = _near(places, len(pattern), len(ids))
                    around = np.concatenate([x for a, b in stretches for x in (ids[a:b], gap)])
                    matched = sum(length for _, _, length in tile(pattern, around, min(min_tile, len(pattern))))
                    if matched >= coverage * len(pattern):
                        rows.append((doc, digest, item, matched, len(pattern), matched / len(pattern)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "text_hash", "item_id", "matched", "item_words", "coverage"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    min_tile: int = MIN_TILE,
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """One row (``LEAK``) per document and benchmark item of which tiles cover at least ``coverage``.

    Words are runs of letters, digits and underscores in lower case. Items with fewer words than a seed must occur whole;
    items without words, null and empty texts hold nothing. Equal item ids with different texts are items of their own
    with one id. Null ids stay null; repeated rows give repeated rows; other columns are ignored; an empty table on either
    side gives no rows. ``text_hash`` is the XXH64 of the document's text.
    """
    if not seed_words >= min_tile >= 1:
        raise ValueError("a tile has at least one word and at most as many as a seed")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text).alias("text"))
    items = items.where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    cuts = max(1, ceil(2 * chars / block_chars))
    found = None
    for cut in range(cuts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(cuts)) == cut).collect()
        # Item ids may repeat or be null: inside a block items go by number.
        block = Block.of([(n, r.text) for n, r in enumerate(own)], seed_words)
        numbers = docs.sparkSession.createDataFrame(
            [(n, r.item) for n, r in enumerate(own)] or [(-1, None)], "number long, item long"
        )
        hits = map_arrow(rows, _holds(block, seed_words, min_tile, coverage), LEAK)
        hits = hits.join(F.broadcast(numbers), hits["item_id"] == numbers["number"])
        hits = hits.withColumn("item_id", F.col("item")).drop("number", "item")
        found = hits if found is None else found.unionByName(hits)
    return found


def without_leaks(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; a row is known by its id and text."""
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col(id_column).eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash"))
    return docs.join(bad, same, "left_anti")

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from recurra.llm.queries import op1_tiling
from recurra.llm.tiling import leaks, tile, tokens, without_leaks
from tests.llm.conftest import DATA


def brute_tiles(pattern, text, least):
    """Greedy string tiling as defined: mark the longest free matches until none has ``least`` words."""
    free_p, free_t, tiles = [True] * len(pattern), [True] * len(text), []
    while True:
        best = []
        longest = least
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while (
                    p + k < len(pattern)
                    and t + k < len(text)
                    and free_p[p + k]
                    and free_t[t + k]
                    and pattern[p + k] == text[t + k]
                ):
                    k += 1
                if k > longest:
                    longest, best = k, [(p, t)]
                elif k == longest:
                    best.append((p, t))
        if not best:
            return tiles
        for p, t in best:
            if all(free_p[p : p + longest]) and all(free_t[t : t + longest]):
                free_p[p : p + longest] = [False] * longest
                free_t[t : t + longest] = [False] * longest
                tiles.append((p, t, longest))


def test_tiles_cover_as_much_as_brute_force():
    rng = random.Random(2)
    for case in range(150):
        letters = rng.choice([2, 5, 30])
        pattern = [rng.randrange(letters) for _ in range(rng.randint(1, 60))]
        cut = rng.randrange(len(pattern))
        text = pattern[cut:] + [rng.randrange(letters) for _ in range(rng.randint(0, 30))] + pattern[:cut]
        found = tile(np.array(pattern), np.array(text), 3)
        covered_p = [i for p, _, n in found for i in range(p, p + n)]
        covered_t = [i for _, t, n in found for i in range(t, t + n)]
        assert len(set(covered_p)) == len(covered_p) and len(set(covered_t)) == len(covered_t)
        assert all(pattern[p : p + n] == text[t : t + n] and n >= 3 for p, t, n in found)
        expected = sum(n for _, _, n in brute_tiles(pattern, text, 3))
        if letters == 30:
            assert sum(n for *_, n in found) == expected
        else:
            assert sum(n for *_, n in found) >= 0.8 * expected


def prose(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]


def test_reordered_passages_are_found_and_clean_documents_left(spark, documents):
    rng = random.Random(9)
    items = [(i, prose(rng, 40)) for i in range(6)] + [(6, ["short", "one"]), (7, []), (7, prose(rng, 30))]
    benchmark = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in items], "item_id long, text string")

    def inside(words):
        return " ".join([*prose(rng, 60), *words, *prose(rng, 200)])

    a, b, c = items[0][1], items[1][1], items[2][1]
    rows = [
        (1, inside(a)),
        (2, inside(b[20:] + ["between"] + b[:20])),
        (3, inside([w.upper() + "," for w in c])),
        (4, inside(a + b)),
        (5, inside(a[:15])),
        (6, inside([])),
        (7, "Short one"),
        (8, None),
        (9, ""),
        (None, inside(a)),
        (11, inside(items[8][1])),
        (12, " ".join(prose(rng, 30_000) + c)),
    ]
    docs = documents(rows + [rows[0]]).withColumn("item_id", F.lit("clash"))
    expected = [(-1, 0), (1, 0), (1, 0), (2, 1), (3, 2), (4, 0), (4, 1), (7, 6), (11, 7), (12, 2)]
    for block_chars in (16_000_000, 500):
        found = leaks(docs, benchmark, block_chars=block_chars)
        assert sorted((r.doc_id or -1, r.item_id) for r in found.collect()) == expected
    kept = without_leaks(docs, found)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 8, 9]
    assert leaks(documents([]), benchmark).count() == 0
    assert leaks(docs, benchmark.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    expected = set()
    for d in docs:
        own = tokens(d.text)
        seeds = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for item in items:
            words = tokens(item.text)
            if any(tuple(words[i : i + 5]) in seeds for i in range(len(words) - 4)):
                if sum(n for *_, n in brute_tiles(words, own, 3)) >= 0.8 * len(words):
                    expected.add((d.doc_id, item.item_id))
    found = op1_tiling(spark, DATA).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert expected and all(0.8 <= r.coverage <= 1 for r in found)

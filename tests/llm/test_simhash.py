from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from recurra.llm.graph import components
from recurra.llm.queries import op9_simhash
from recurra.llm.simhash import link_fingerprints, near_duplicates
from tests.llm.conftest import DATA


def brute_fingerprint(text, shingle=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    tokens = [w for w in lowered.split(" ") if w]
    if not tokens:
        return 0
    groups = [tokens[i : i + shingle] for i in range(max(1, len(tokens) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in groups]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    rows = sorted(rows, key=lambda r: r[0])
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints, 4)
    return sorted((i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots))


def test_equals_brute_force(spark, documents, some_texts):
    rows = list(enumerate(some_texts, start=3))
    docs = documents(rows).withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1))
    assert sorted(map(tuple, near_duplicates(docs).collect())) == expected(rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op9_simhash(spark, DATA).collect())) == expected([tuple(r) for r in docs])


def test_anchors_find_every_link(spark):
    rng = random.Random(1)
    for distance in (1, 4):
        prints = [rng.getrandbits(64) for _ in range(40)]
        for p in prints[:30]:
            flipped = p
            for b in rng.sample(range(64), rng.randint(1, distance + 2)):
                flipped ^= 1 << b
            prints.append(flipped)
        prints = sorted(set(prints))
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
        for block_rows in (3, 20_000):
            found = {r.node: r.component for r in components(link_fingerprints(df, distance, block_rows)).collect()}
            groups = {}
            for s, r in zip(signed, brute_components(prints, distance)):
                groups.setdefault(r, set()).add(s)
            ours = {}
            for s in signed:
                ours.setdefault(found.get(s, s), set()).add(s)
            assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_blocks_of_a_heavy_anchor_lose_no_link(spark):
    """Prints that share a part are all at home with one anchor; a link of 0, 2 and 2 bits in the parts has no other."""
    rng = random.Random(2)
    hub = rng.getrandbits(64)
    prints = {hub}
    while len(prints) < 80:
        bits = rng.sample(range(21, 42), 2) + rng.sample(range(42, 64), 2)
        prints.add(hub ^ sum(1 << b for b in bits))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    for block_rows in (5, 20_000):
        found = {r.node: r.component for r in components(link_fingerprints(df, 4, block_rows)).collect()}
        assert found.keys() == set(signed) and len(set(found.values())) == 1


def test_null_ids_repeated_rows_and_empty_tables(spark, documents):
    docs = documents([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (9, None), (7, "")])
    found = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert found == [(-1, 5), (5, 5), (5, 5), (7, 7), (9, 7)]
    assert near_duplicates(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(50)]
    pairs += [(999, i) for i in range(500, 600)] + [(7, 7), (None, 3), (4, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert found.pop(node) == min(seen)
    assert not found

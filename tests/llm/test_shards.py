from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recurra.llm.queries import op4_shards
from recurra.llm.shards import balanced_shards
from tests.llm.conftest import DATA


def check(rows, docs, shards, most):
    """Rows are whole, slots gapless, bytes even; returns the shards of each text."""
    expected = Counter()
    for i, t in docs:
        raw = (t or "").encode()
        expected[(i, len(raw) + 1, zlib.crc32(raw))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    assert max(loads.values()) - min(loads[s] for s in range(shards)) <= most
    return loads


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = op4_shards(spark, DATA).collect()
    loads = check(rows, docs, 8, 1000)
    groups = defaultdict(list)
    text = dict(docs)
    for r in rows:
        groups[text[r.doc_id]].append(r.shard)
    copies = [g for g in groups.values() if len(g) > 1]
    together = sum(max(Counter(g).values()) for g in copies) / sum(map(len, copies))
    assert together >= 0.9, loads


def test_only_dataframe_functions(spark):
    plan = op4_shards(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_group_nulls_and_repeated_rows(spark, documents):
    rows = [(i, "the same text again") for i in range(300)]
    rows += [(1000 + i, f"another text {i // 3} " + "x" * (i % 50)) for i in range(600)]
    rows += [(None, None), (None, ""), (3, "the same text again"), (3, "the same text again"), (5000, None), (5001, "y" * 900)]
    docs = documents(rows).withColumn("shard", F.lit("clash")).withColumn("key", F.lit(0))
    check(balanced_shards(docs).collect(), rows, 8, 100)


def test_small_tables(spark, documents):
    assert balanced_shards(documents([])).count() == 0
    assert [tuple(r) for r in balanced_shards(documents([(4, None)])).collect()][0][1:3] == (1, 0)

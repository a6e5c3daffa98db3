from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recurra.llm.tiling import tokens
from tests.llm import test_lines, test_simhash, test_tiling, test_tokens
from tests.llm.conftest import DATA

STAGE = dict(corpus_pipeline.STAGES)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language":
            assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            gone = {(r[0], r[1]) for r in test_lines.brute(before) if not r[6]}
            expected = [
                (i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in before
            ]
            assert after == sorted(expected)
        elif name == "simhash_dedup":
            first = {i for i, _, c in test_simhash.expected(before) if i == c}
            assert after == sorted((i, t) for i, t in before if i in first)
        else:
            expected = []
            for i, t in before:
                own = tokens(t)
                seeds = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
                leak = False
                for item in items:
                    words = tokens(item.text)
                    if any(tuple(words[k : k + 5]) in seeds for k in range(len(words) - 4)):
                        covered = sum(n for *_, n in test_tiling.brute_tiles(words, own, 3))
                        leak |= covered >= 0.8 * len(words)
                if not leak:
                    expected.append((i, t))
            assert after == sorted(expected)
    ids = dict(zip([i for i, _ in before], test_tokens.plain_ids([t for _, t in before])))
    test_tokens.check_pieces([r.asDict() for r in docs.collect()], ids, 4096)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns[0] == "doc_id" and rows.count() > 0


@pytest.mark.parametrize("name", ["language", "line_dedup", "simhash_dedup", "decontamination", "packing"])
def test_odd_rows(spark, documents, name):
    text = "the same words that stand in every one of these texts"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "\n"), (None, None), (5, text + " changed", None, None)]
    docs = documents(rows).withColumn("hash", F.lit("clash"))
    found = STAGE[name](spark, docs, DATA)
    if name != "packing":
        assert found.columns == docs.columns
    assert found.count() <= 2 * len(rows)
    if name == "simhash_dedup":
        assert sorted(r.doc_id for r in found.collect()) == [1, 2, 5]
        check_one_of_each_group(spark, documents)
    empty = STAGE[name](spark, documents([]), DATA)
    assert empty.count() == 0


def check_one_of_each_group(spark, documents):
    """Rows are told apart by id and text: unique texts stay under a null id and under an id that others share."""
    base, other, third = ["".join(f"{w}{i} " for i in range(900)) for w in ("alpha", "beta", "gamma")]
    near = base.replace("alpha7 ", "changed ")
    rows = [(1, base), (None, base), (None, other), (3, third), (3, base), (3, near), (7, third + "z"), (7, "unique words of one row")]
    rows += [(8, "words of a row given twice"), (8, "words of a row given twice"), (None, other)]
    found = STAGE["simhash_dedup"](spark, documents(rows), DATA)
    groups = test_simhash.expected([(i, t) for i, (_, t) in enumerate(rows)])
    assert {c for *_, c in groups} == {0, 2, 3, 7, 8}
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(
        [(1, base), (None, other), (3, third), (7, "unique words of one row"), (8, "words of a row given twice")], key=str
    )

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.llm.negatives import Block, Search, hard_negatives, integer_matrix, spanning_tree
from recurra.llm.queries import ORACLE, op11_negatives
from tests.comparison import assert_same, sql_connection

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=5, relabel=(7, 10)):
    sound = []
    for key, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % relabel[1] if key is not None and key % relabel[0] == 0 else label
        sound.append((key, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for anchor in {r for r in sound if r[0] is not None and r[0] % every == 0}:
        others = list(sound)
        others.remove(anchor)
        scored = [(-sum(a * b for a, b in zip(anchor[2], v)), k is None, k, lab) for k, lab, v in others if len(v) == len(anchor[2])]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for place, (p, _, k, _) in enumerate([r for r in scored if r[3] == anchor[1]][:positives], 1):
            near = [r for r in scored if r[3] != anchor[1] and -80 * p <= -100 * r[0] <= -100 * p][:negatives]
            out += [(anchor[0], k, rank, r[2], -p, -r[0], place) for rank, r in enumerate(near, 1)]
    return out


def clustered(n, dims=8, seed=4, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    near = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * spread
    return (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32).tolist()


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(clustered(400))]
    rows += [rows[20]] * 3 + [rows[21], (30, rows[31][1], 2), (None, rows[20][1], 1), (None, rows[5][1], rows[40][2])]
    rows += [(1000, None, 1), (1010, [], 1), (1020, [], 2), (1021, [], 1), (1030, [1.0, 2.0], 1), (1031, [1.0, 2.0], 1), (1032, [1.0, 1.5], 2)]
    rows += [(1040, rows[2][1], None), (1050, [float("nan")] * 8, 1), (1060, [1.0, None] * 4, 1), (1070, [0.0] * 8, 1), (1080, [-x for x in rows[3][1]], 9)]
    rows += [(2000, [2e6] * 8, 1), (2001, [1.6e6] * 8, 1), (2002, [1.5e6] * 8, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("id", "vector", "part", "length", "score", "anchor"):
        df = df.withColumn(clash, F.lit("clash"))
    found = hard_negatives(df.repartition(6), anchors_every=10, block=block).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)
    assert len(found) > 300


def test_tree_spans_and_is_short():
    data = integer_matrix(clustered(200), 256)
    order, parents, edges = spanning_tree(data)
    assert sorted(order) == list(range(200)) and (parents == -1).sum() == 1
    seen = set()
    for node, parent, edge in zip(order, parents, edges):
        assert parent == -1 or (parent in seen and abs(np.linalg.norm(data[node] - data[parent]) - edge) < 1e-4)
        seen.add(node)
    assert edges.sum() < np.linalg.norm(data[1:] - data[:-1], axis=1).sum() / 2


def test_bounds_spare_most_scores():
    """On clustered vectors few rows are scored, and the best are those of all scores."""
    data = integer_matrix(clustered(4000, dims=16, spread=0.02), 256)
    labels = np.arange(4000) % 2
    anchors = np.arange(0, 4000, 40)
    asked = Block(anchors, labels[anchors], data[anchors], [[(-(2**62), 2**62)]] * 100, True, 6, 256)
    search = Search(asked)
    for at in range(0, 4000, 1000):
        search.add(np.arange(at, at + 1000), labels[at : at + 1000], data[at : at + 1000])
    assert search.scored < 100 * 4000 / 2 * 0.5
    scores = data[anchors] @ data.T
    for anchor, node in enumerate(anchors):
        mine = np.flatnonzero(labels == labels[node])
        best = sorted(zip(-scores[anchor, mine], mine))[:6]
        assert [(-s, i) for s, i in best] == [tuple(x) for x in search.best[anchor][0].T]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    with sql_connection(folder) as con:
        assert_same(op11_negatives(spark, folder), con, ORACLE["op11_negatives"])


def test_scores_beyond_64_bits_raise(spark):
    rows = [(100, [1e20], 1), (101, [1e20], 1), (102, [1e20], 2)]
    with pytest.raises(Exception, match="(?i)overflow|too large|out of bounds"):
        hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()


def test_empty_table(spark):
    empty = hard_negatives(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

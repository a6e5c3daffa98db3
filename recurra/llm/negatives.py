"""Hard negatives of anchor vectors, found through bounds along a spanning tree of the anchors.

Anchors are taken in blocks of bounded size. The anchors of a block form a minimum spanning tree by distance. For a vector x
the scores of two anchors differ by at most their distance times the norm of x, so the bounds of a parent's scores, widened by
the edge, bound the child's; only vectors whose bounds overlap the window that is still open are scored anew, which makes
their bounds exact for the children below. Every block is held against all vectors where they lie: a task keeps the best
few of each anchor and window, and only these are shuffled. Nothing is grouped by label and no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.llm.common import Batches, fixed, map_arrow
from recurra.settings import new_folder

BLOCK = 1024
_ROWS = 4096
_NULL_ID = np.iinfo(np.int64).max
_EXACT = 2.0**53
_FOUND = "anchor int, window int, id long, score long"


def integer_matrix(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length; whole numbers as float64 where that is exact, else Python integers."""
    scaled = np.floor(np.array(vectors, np.float64).reshape(len(vectors), -1) * scale)
    largest = np.abs(scaled).max(initial=0)
    if largest * largest * max(1, scaled.shape[1]) < _EXACT:
        return scaled
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def _dot(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products; Python integers if either side needs them."""
    if vectors.dtype == anchor.dtype:
        return vectors @ anchor
    whole = [x if x.dtype == object else x.astype(np.int64).astype(object) for x in (vectors, anchor)]
    return whole[0] @ whole[1]


def _norms(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # Rounded up a little, so that a bound is never too tight.
    return np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree by distance: visiting order, and parent (-1: none) and edge length in that order."""
    vectors = vectors.astype(np.float64)
    n = len(vectors)
    order, parents, edges = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    nearest, best = np.full(n, -1), np.full(n, np.inf)
    waiting = np.ones(n, bool)
    node = 0
    for at in range(n):
        order[at], parents[at], edges[at] = node, nearest[node], 0 if nearest[node] < 0 else best[node]
        waiting[node] = False
        gaps = vectors - vectors[node]
        distance = np.sqrt((gaps * gaps).sum(axis=1)) * (1 + 1e-9)
        closer = waiting & (distance < best)
        nearest[closer], best[closer] = node, distance[closer]
        if at + 1 < n:
            node = int(np.argmin(np.where(waiting, best, np.inf)))
    return order, parents, edges


@dataclass
class Block:
    """Anchors of one length beside what is asked of them.

    ``windows`` holds for each anchor the (lowest, highest) scores whose best rows are wanted; ``own_label`` says whether
    these are rows of the anchor's label, itself left out once, or of other labels.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int]]]
    own_label: bool
    keep: int
    scale: int

    def __post_init__(self):
        self.tree = spanning_tree(self.vectors)


class Search:
    """The best rows per anchor and window among the vectors of one task, block of vectors by block."""

    def __init__(self, block: Block):
        self.block = block
        # Best first: scores down, then ids up.
        self.best = [[np.zeros((2, 0), np.int64) for _ in w] for w in block.windows]
        self.scored = 0

    def _floor(self, anchor: int) -> float:
        """No row below this score is wanted any more."""
        block = self.block
        lows = []
        for (low, _), best in zip(block.windows[anchor], self.best[anchor]):
            full = best.shape[1] >= block.keep
            lows.append(max(low, int(best[0, block.keep - 1])) if full else low)
        return min(lows, default=np.inf)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        block = self.block
        if not len(ids):
            return
        norms = _norms(vectors)
        low, high = {}, {}
        order, parents, edges = block.tree
        children = np.bincount(parents[parents >= 0], minlength=len(order))
        for node, parent, edge in zip(order.tolist(), parents.tolist(), edges.tolist()):
            if parent < 0:
                lower, upper = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
            else:
                reach = edge * norms + 1
                lower, upper = low[parent] - reach, high[parent] + reach
                children[parent] -= 1
                if not children[parent]:
                    del low[parent], high[parent]
            mine = labels == block.labels[node]
            windows = block.windows[node]
            wanted = (upper >= self._floor(node)) & (mine if block.own_label else ~mine)
            if windows:
                wanted &= lower <= max(h for _, h in windows)
            # The root is scored for all rows: its scores are what the bounds below come from.
            chosen = np.arange(len(ids)) if parent < 0 else np.flatnonzero(wanted)
            if len(chosen):
                scores = _dot(vectors[chosen], block.vectors[node])
                self.scored += len(chosen)
                lower[chosen] = upper[chosen] = scores.astype(np.float64)
                kept = wanted[chosen]
                if kept.any():
                    self._keep(node, ids[chosen[kept]], scores[kept].astype(np.int64))
            if children[node]:
                low[node], high[node] = lower, upper

    def _keep(self, anchor: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = self.block.keep
        for at, (low, high) in enumerate(self.block.windows[anchor]):
            some = (scores >= low) & (scores <= high)
            if some.any():
                both = np.concatenate([self.best[anchor][at], np.stack([scores[some], ids[some]])], axis=1)
                self.best[anchor][at] = both[:, np.lexsort((both[1], -both[0]))[:keep]]

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        for anchor, windows in enumerate(self.best):
            for window, best in enumerate(windows):
                yield from ((anchor, window, int(i), int(s)) for s, i in best.T)


def _best_of(rows: DataFrame, block: Block) -> DataFrame:
    """The ``keep`` best rows of each anchor and window as ``_FOUND``; a null id stands last among equal scores."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    dims = block.vectors.shape[1]

    def run(batches: Batches) -> Batches:
        search = Search(shared.value)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch["vector"]), dims))
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                ids = some["id"].fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                vectors = integer_matrix(some["vector"].to_pylist(), shared.value.scale)
                search.add(ids, np.array(some["label"].to_pylist()), vectors)
        found = list(zip(*search.rows()))
        if found:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "window", "id", "score"])

    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    found = map_arrow(rows, run, _FOUND)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= block.keep)


def sound_rows(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows whose label, vector and components are there and finite."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def hard_negatives(
    vectors: DataFrame,
    anchors_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: int = 256,
    relabel: tuple[int, int] | None = (7, 10),
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) and positive_rank per hard negative.

    Components x become floor(scale * x) and a score is an exact inner product. Rows without a label, without a vector, or
    with a null or non-finite component take no part. ``relabel`` (d, m) first turns the label of ids divisible by d into
    (label + 1) mod m. Anchors are the ids divisible by ``anchors_every``. An anchor's positives are its best ``positives``
    other rows of its label; per positive come the best ``negatives`` rows of other labels whose score is at least
    share[0] / share[1] of the positive's and not above it. Equal scores: smaller id first, null ids last.

    Rows meet only rows of their vectors' length. Rows with a null id are no anchors, but may be found. Repeated rows are found
    as often as they are there, so a copy of an anchor is its positive; equal rows (id, label, vector) are one anchor. Other
    columns are ignored; an empty table gives no rows. Scores beyond 64 bits raise an error.
    """
    rows = sound_rows(vectors, id_column, vector, label)
    if relabel:
        moved = F.when(F.col("id") % relabel[0] == 0, (F.col("label") + 1) % relabel[1]).otherwise(F.col("label"))
        rows = rows.withColumn("label", moved)
    rows = fixed(rows)
    spark = rows.sparkSession
    chosen = rows.where(F.col("id") % anchors_every == 0).distinct()
    lengths = chosen.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    parts = lengths.select("length", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "label", "vector"), F.col("parts")).cast("int")
    sized = chosen.withColumn("length", F.size("vector")).join(fixed(parts), "length")
    chosen = fixed(sized.withColumn("part", part).select("length", "part", "id", "label", "vector"))

    fields = ["anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long", "positive_rank int"]
    schema = T.StructType.fromDDL(", ".join(fields))
    out = new_folder(spark, "table")
    spark.createDataFrame([], schema).write.parquet(out)
    for key in chosen.select("length", "part").distinct().toLocalIterator():
        mine = chosen.where((F.col("length") == key["length"]) & (F.col("part") == key["part"])).orderBy("id", "label", "vector")
        _block_negatives(rows, mine.collect(), positives, negatives, share, scale).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _block_negatives(rows: DataFrame, anchors: list, positives: int, negatives: int, share: tuple[int, int], scale: int) -> DataFrame:
    ids = np.array([a["id"] for a in anchors], np.int64)
    labels = np.array([a["label"] for a in anchors])
    matrix = integer_matrix([a["vector"] for a in anchors], scale)
    lowest, highest = -(2**63), 2**63 - 1
    # One more than asked for: an anchor finds itself too.
    asked = Block(ids, labels, matrix, [[(lowest, highest)] for _ in anchors], True, positives + 1, scale)
    per_anchor: list[list] = [[] for _ in anchors]
    for r in _best_of(rows, asked).orderBy("anchor", "place").collect():
        per_anchor[r["anchor"]].append((r["score"], r["id"]))
    pairs, windows = [], []
    own = [int(s) for s in (matrix * matrix).sum(axis=1)] if len(matrix) else []
    for anchor, found in enumerate(per_anchor):
        me = (own[anchor], int(ids[anchor]))
        if me in found:
            found.remove(me)
        found = found[:positives]
        # 80 p <= 100 n <= 100 p, in whole numbers.
        windows.append([(-(-share[0] * p // share[1]), p) for p, _ in found])
        pairs += [(anchor, at, int(ids[anchor]), key, score) for at, (score, key) in enumerate(found)]
    asked = Block(ids, labels, matrix, windows, False, negatives, scale)
    named = "anchor int, window int, anchor_id long, positive_id long, positive_score long"
    named = rows.sparkSession.createDataFrame(pairs, named)
    found = _best_of(rows, asked).join(F.broadcast(named), ["anchor", "window"])

    def known(column: str):
        return F.nullif(F.col(column), F.lit(int(_NULL_ID)))

    return found.select(
        "anchor_id",
        known("positive_id").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        known("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        (F.col("window") + 1).alias("positive_rank"),
    )


def negatives_sql(every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256) -> str:
    """The same over a table ``embeddings`` of unique ids as SQL, with every anchor against every row."""
    low, high = share
    return f"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM sound a JOIN sound r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % {every} = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
         CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS INTEGER) AS positive_rank
  FROM scored WHERE same QUALIFY positive_rank <= {positives})
SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, positive_rank,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND {low} * positive_score <= {high} * score AND score <= positive_score
QUALIFY rank <= {negatives}"""

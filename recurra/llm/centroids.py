"""K-means over integer vectors with DataFrame functions only.

Centroids are few and become literal arrays of the plan. ``zip_with`` and ``aggregate`` give the squared distance to each of
them and ``array_min`` over (distance, number) structs the nearest, so a round is one scan and one aggregation of column
sums, combined before its shuffle: what is moved is one row per task and cluster, whatever a cluster's size. Only those sums
reach the driver, which divides them exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import fixed

Centroid = tuple[int, ...]


def integer_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024
) -> DataFrame:
    """(id, v) of the vectors with exactly ``dims`` components, none null or non-finite; v holds floor(scale * x)."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("x") == dims) & sound)
    return rows.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[Centroid]:
    """The ``k`` vectors with the smallest sha256 of ``<salt>:<id>``; equal hashes by vector, null ids last."""
    text = F.concat(F.lit(f"{salt}:"), F.col("id").cast("string"))
    order = [F.asc_nulls_last("hash"), F.asc("v")]
    chosen = rows.select(F.sha2(text, 256).alias("hash"), "v").orderBy(*order).limit(k)
    return [tuple(r["v"]) for r in chosen.collect()]


def nearest(v: str, centroids: list[Centroid]) -> Column:
    """Struct (distance, cluster) of the nearest centroid by squared distance; the smaller number wins a tie."""
    each = []
    for i, c in enumerate(centroids):
        literal = ", ".join(f"{x}L" for x in c)
        squares = f"zip_with({v}, array({literal}), (a, b) -> (a - b) * (a - b))"
        each.append(f"named_struct('distance', aggregate({squares}, 0L, (total, x) -> total + x), 'cluster', {i})")
    return F.expr(f"array_min(array({', '.join(each)}))")


def next_centroids(rows: DataFrame, centroids: list[Centroid]) -> list[Centroid]:
    """One round: assign every vector, then floor(sum / count) per component; an empty cluster keeps its centroid."""
    dims = len(centroids[0])
    assigned = rows.select("v", nearest("v", centroids)["cluster"].alias("cluster"))
    sums = assigned.groupBy("cluster").agg(F.expr("count(1) AS n"), *[F.expr(f"sum(v[{i}]) AS s{i}") for i in range(dims)])
    moved = list(centroids)
    for r in sums.collect():
        moved[r["cluster"]] = tuple(r[f"s{i}"] // r["n"] for i in range(dims))
    return moved


def centroid_clusters(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    salt: str = "3",
    scale: int = 1024,
    dims: int = 64,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """One row (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that takes part.

    Vectors that are null, have another number of components than ``dims``, or hold a null or non-finite one take no part.
    Repeated rows are as many vectors, also among the first centroids; with fewer than ``k`` vectors there are as many
    centroids as vectors, and an empty table gives no rows. Null ids take part and come last where ids decide. Ties go to
    the smaller cluster. Sums and distances are exact 64-bit integers: components below 2^17 in magnitude always fit, and
    Spark's ANSI arithmetic raises an error instead of a wrong number where larger ones do not. Other columns are ignored.
    """
    rows = fixed(integer_vectors(vectors, id_column, vector, dims, scale))
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select(F.col("id").alias(id_column), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    assigned = fixed(rows.select("id", nearest("v", centroids).alias("near")).select("id", "near.cluster", "near.distance"))
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))])
    return assigned.select(
        F.col("id").alias(id_column),
        "cluster",
        "distance",
        of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.array(*[F.lit(d) for d in digests])[F.col("cluster")].alias("centroid_sha256"),
    )


def clusters_sql(k: int = 8, rounds: int = 10, salt: str = "3", scale: int = 1024, dims: int = 64) -> str:
    """The same over table ``embeddings`` as SQL, one common table per round."""
    kept = f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})"""
    first = f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{salt}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [kept, "numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM kept)", first]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(distance := {distance}, cluster := cluster)) AS near FROM numbered, c{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(q ORDER BY dim) AS c FROM (
      SELECT cluster, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (
        SELECT near.cluster AS cluster, dim, sum(v[dim]) AS s, count(*) AS n
        FROM a{i} JOIN numbered USING (r), range(1, {dims + 1}) t(dim) GROUP BY ALL))
    GROUP BY cluster) m ON m.cluster = c{i}.cluster)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, near.cluster AS cluster, near.distance AS distance,
       CAST(sum(near.distance) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN numbered USING (r) JOIN c{rounds} ON c{rounds}.cluster = near.cluster"""

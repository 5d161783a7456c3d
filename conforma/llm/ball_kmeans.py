"""Ball k-means over integer vectors: exact assignments with few comparisons.

A cluster is a ball: its centroid, and the largest distance of a member to it. Another centroid can only be nearer to
a member if half its distance from the ball's centroid is at most the radius (a neighbour). Members nearer than half the
way to the nearest neighbour are the stable core and stay. The others lie in annuli, bounded by half the distances
of the neighbours in ascending order: a member is compared with the neighbours whose half distance it reaches, no others.
Radii are taken of the members that a batch holds, which is a smaller ball and as exact.

All arithmetic is on integers, so that ties and sums are exact in any partitioning. Each round writes vectors with
their clusters once, and beside them each task's sums by cluster; k rows of sums come to the driver.

Defined cases: vectors of another length, with null or non-finite components, and null vectors are left out; components
beyond 2^27 in size (after scaling) count as that; rows without an id are kept, and come last when centroids are chosen;
repeated rows are vectors of their own (ties by components); fewer vectors than k give fewer centroids; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

DIM = 64
K = 40
ROUNDS = 5
SCALE = 256
SALT = "2:"
LARGEST = 1 << 27

FIELDS = "vec_id {kind}, vec array<int>, cluster int, distance long, n long, total array<long>"


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = rows - centroid
    return np.einsum("ij,ij->i", away, away)


def compared(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of ties) and squared distance, by comparing all."""
    best = np.zeros(len(rows), np.int64)
    distance = squared(rows, centroids[0])
    for j in range(1, len(centroids)):
        other = squared(rows, centroids[j])
        closer = other < distance
        best[closer], distance[closer] = j, other[closer]
    return best, distance


def quarters(centroids: np.ndarray) -> np.ndarray:
    """Squared half distances between centroids, rounded up."""
    return np.stack([(squared(centroids, c) + 3) // 4 for c in centroids])


def reassigned(rows: np.ndarray, before: np.ndarray, centroids: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids and squared distances of rows that were in clusters before; and how many distances were
    computed besides those to the own centroids."""
    best, distance, spent = before.astype(np.int64), np.zeros(len(rows), np.int64), 0
    for own in np.unique(before):
        members = np.flatnonzero(before == own)
        away = squared(rows[members], centroids[own])
        half = halves[own].copy()
        half[own] = np.iinfo(np.int64).max
        neighbours = np.flatnonzero(half <= away.max())
        neighbours = neighbours[np.argsort(half[neighbours], kind="stable")]
        annulus = np.searchsorted(half[neighbours], away, side="right")  # 0: the stable core
        nearest, least = np.full(len(members), own), away.copy()
        for k, j in enumerate(neighbours):
            reach = np.flatnonzero(annulus > k)
            other = squared(rows[members[reach]], centroids[j])
            spent += len(reach)
            closer = (other < least[reach]) | ((other == least[reach]) & (j < nearest[reach]))
            nearest[reach[closer]], least[reach[closer]] = j, other[closer]
        best[members], distance[members] = nearest, least
    return best, distance, spent


def vectors(rows: DataFrame, vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (array of int): the scaled components of vectors that have dim finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = float(LARGEST)
    bound = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * scale))).cast("int"))
    return rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", bound.alias("vec"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(key.alias("key"), "vec").orderBy(F.asc_nulls_last("key"), "vec").limit(k).collect()
    return np.array([r["vec"] for r in chosen], np.int64)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row for each vector with its cluster and distance, and one for each task and cluster with n and total,
    the sum of its vectors. Rows without a cluster are compared with all centroids."""
    halves, dim = quarters(centroids), centroids.shape[1]

    def run(batches):
        n, total, id_type = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), None
        names = ["vec_id", "vec", "cluster", "distance", "n", "total"]
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.column(0).type
            own = batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.int64)
            if batch.column(2).null_count:
                best, distance = compared(own, centroids)
            else:
                best, distance, _ = reassigned(own, batch.column(2).to_numpy(), centroids, halves)
            n += np.bincount(best, minlength=len(n))
            np.add.at(total, best, own)
            more = [pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(len(best), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(own, pa.int32()), *more, pa.nulls(len(best), pa.list_(pa.int64()))], names=names
            )
        used = np.flatnonzero(n)
        if len(used):
            none = [pa.nulls(len(used), kind) for kind in (id_type, pa.list_(pa.int32()))]
            rest = [pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.array(n[used], pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *rest, lists(total[used], pa.int64())], names=names)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "vec", "cluster").mapInArrow(run, FIELDS.format(kind=kind))


def moved(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floors of their vectors' means; those without vectors stay. One row each comes here."""
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for cluster, n, *total in sums.groupBy("cluster").agg(F.sum("n"), *totals).collect():
        out[cluster] = [t // n for t in total]
    return out


def clusters(
    rows: DataFrame, k: int = K, rounds: int = ROUNDS, vector: str = "embedding", dim: int = DIM, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vec (scaled components), cluster, distance) and the final centroids."""
    scratch = Scratch(rows.sparkSession, "ball-kmeans")
    found = vectors(rows, vector, dim, scale)
    centroids = first_centroids(found, k, salt)
    held = found.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
    for turn in range(rounds + 1 if len(centroids) else 0):
        both = scratch.write(assign(held, centroids), f"round-{turn}")
        held = both.filter("vec is not null").select("vec_id", "vec", "cluster", "distance")
        if turn < rounds:
            centroids = moved(both.filter("vec is null").select("cluster", "n", "total"), centroids)
        if turn:
            scratch.remove(f"round-{turn - 1}")
    return held, centroids


def query(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    texts = (",".join(map(str, c)) for c in centroids.tolist())
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(x.encode()).hexdigest()) for i, x in enumerate(texts)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("vec").join(F.broadcast(of), "cluster")  # k rows


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> str:
    """The same rounds with all distances. Rows are named by number, as ids may repeat."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id), vec) - 1 AS INTEGER) AS cluster, vec
  FROM kept QUALIFY cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT row, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT v.row, c.cluster, CAST(list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM kept v, c{i} c)
  GROUP BY row
)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (
  SELECT a.cluster, p.i, CAST(sum(v.vec[p.i]) AS BIGINT) AS s, count(*) AS n
  FROM a{i} a JOIN kept v USING (row), (SELECT unnest(range(1, {dim + 1})) AS i) p GROUP BY a.cluster, p.i
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS vec FROM s{i} GROUP BY cluster) m USING (cluster)
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT k.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (row) JOIN c{rounds} c ON c.cluster = a.cluster"""
    )


SQL = _sql()

"""Centroid clustering with equal-average equal-variance nearest-neighbour search.

Vectors become integers. Centroids are kept sorted by the sum of their components
(their mean, without the division). A vector starts at its own sum and scans
outward, always the side whose mean is nearer. With S the sum and W = sqrt(d *
sum of (x - mean)^2) of a vector of d components,

    d * distance^2 >= (S_x - S_c)^2 + (W_x - W_c)^2.

The first term alone ends the scan (means only get further away), both together
reject a centroid without measuring it; what is left is measured in exact
integers. The bounds are floats with a margin towards measuring, so rounding can
cost a measurement and never an answer. Ties go to the smaller centroid number.

Each round is one pass of the written vectors: a task sums its vectors by cluster
in integers and sends at most k rows; the driver holds k centroids, never vectors.
A cluster with a third of all rows is one such row per task.

Cases: vectors that are null, of another length, or with null or non-finite
components take no part; repeated rows each count; equal start hashes (repeated
ids) are ordered by the vector; a null id is returned but starts no centroid
while real ids are left; fewer vectors than k give fewer centroids; a centroid
without vectors stays as it is; an empty table gives no rows; extra columns are
ignored; a component beyond 2^27 after scaling, whose squared distances no long
could hold, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import release, staged

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SALT = 40, 5, 256, 64, 2
LARGEST = 1 << 27  # of a component: 64 squared differences then fit a long
_FAR = np.int64(1) << 62
_MARGIN = 1e-9


class EqualAverageSearch:
    """Nearest of the given integer centroids, by number; ``measured`` counts exact distances."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.c, self.sums = centroids[self.number], sums[self.number]
        self.deviation, self.measured = _deviation(self.c), 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (n, d), k = x.shape, len(self.c)
        sums, deviation = x.sum(axis=1), _deviation(x)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best, who = np.full(n, _FAR), np.full(n, k)
        left = np.arange(n)
        while len(left):
            lo, hi, s = down[left], up[left], sums[left]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], _FAR)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, _FAR)
            at, gap = np.where(below <= above, lo, hi), np.minimum(below, above)
            mean_term = gap.astype(float) ** 2
            going = (gap < _FAR) & (mean_term * (1 - _MARGIN) <= d * best[left].astype(float))
            left, at, mean_term, from_below = left[going], at[going], mean_term[going], (below <= above)[going]
            down[left] -= from_below
            up[left] += ~from_below
            wx, wc = deviation[left], self.deviation[at]
            apart = np.maximum(np.abs(wx - wc) - 1e-6 * (1 + wx + wc), 0)
            close = (mean_term + apart ** 2) * (1 - _MARGIN) <= d * best[left].astype(float)
            rows, at = left[close], at[close]
            distance = ((x[rows] - self.c[at]) ** 2).sum(axis=1)
            self.measured += len(rows)
            number = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = distance[better], number[better]
        return who, best


def _deviation(x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    return np.sqrt(d * ((x - x.sum(axis=1, keepdims=True) / d) ** 2).sum(axis=1))


def _packer(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False)
            batch = batch.filter(whole)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            finite = np.isfinite(x).all(axis=1)  # nulls came as NaN
            x = x[finite]
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling: its squared distance is no long")
            packed = [row.tobytes() for row in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(finite)), pa.array(packed, pa.binary())], ["vec_id", "vec"])
    return run


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _summer(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (k, width) = EqualAverageSearch(centroids), centroids.shape
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), width)
            if not len(x):
                continue
            who, _ = search.nearest(x)
            order = np.argsort(who, kind="stable")
            found, first = np.unique(who[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(who, minlength=k)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int32()), pa.array(counts[hit]), pa.array(sums[hit].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return run


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = EqualAverageSearch(centroids)
        for batch in batches:
            who, distance = search.nearest(_vectors(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(who, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])
    return run


def _moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the exact means, empty ones unchanged."""
    width = centroids.shape[1]
    parts = packed.select("vec").mapInArrow(_summer(centroids), "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)])
    new = centroids.copy()
    for r in totals.collect():  # at most k rows
        new[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return new


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = DIMENSIONS,
                    salt: int = SALT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    packed = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(
        _packer(scale, width), "vec_id long, vec binary"), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = packed.orderBy(drawn.asc_nulls_last(), "vec").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([np.frombuffer(r["vec"], "<i4") for r in start], np.int64)
    for _ in range(rounds):
        centroids = _moved(packed, centroids)
    assigned = staged(packed.mapInArrow(_assigner(centroids), "vec_id long, cluster int, distance long"), "assigned")
    release(packed)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """DuckDB SQL: one pair of common table expressions a round."""
    near = """a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.e, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS cluster,
         min(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
  FROM v CROSS JOIN c{r} c GROUP BY v.vec_id, v.e)"""
    move = f"""c{{s}} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{{r}} c LEFT JOIN (
    SELECT cluster, list(q ORDER BY j) AS e FROM (
      SELECT cluster, j, CAST((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS q
      FROM (SELECT cluster, unnest(e) AS x, unnest(range({DIMENSIONS})) AS j FROM a{{r}}) GROUP BY cluster, j) GROUP BY cluster) m
  ON m.cluster = c.cluster)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r), move.format(r=r, s=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SALT}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, e
  FROM v ORDER BY sha256('{SALT}:' || CAST(vec_id AS VARCHAR)) LIMIT {CLUSTERS}),
{", ".join(steps)}
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster"""


ORACLE = _oracle()

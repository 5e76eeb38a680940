"""Centroid clustering by the threshold algorithm.

Every dimension keeps its centroids sorted by value.  For a vector all lists
are walked outward from the vector's own value, nearest entry first.  A
centroid met in any list gets its exact distance; one not met yet is at least
as far away in every dimension as that list's frontier, so the search stops
as soon as the sum of the squared frontier distances is strictly greater than
the best exact distance (equal: a smaller number could still come).

All arithmetic is on integers, so rounds, ties and sums are exact and do not
depend on how Spark deals the rows.  Only the centroids, k times the number of
dimensions, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.storage import saved

# Components stay below this, so that a squared distance fits a long.
LIMIT = 1 << 27
# Vectors searched at once: components held by each step's arrays.
CHUNK_CELLS = 1 << 18
_FAR = np.iinfo(np.int64).max


class SortedLists:
    """Centroids with one list per dimension, sorted by value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        value = np.take_along_axis(centroids, self.order, axis=0)
        # an entry beyond either end that no step takes before a real one
        edge = np.full((1, centroids.shape[1]), 4 * LIMIT)
        self.value = np.concatenate((-edge, value, edge))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and squared distance of every row."""
        n, dims = x.shape
        cluster, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = max(1, CHUNK_CELLS // max(1, dims))
        for i in range(0, n, step):
            cluster[i:i + step], distance[i:i + step] = self._walk(x[i:i + step])
        return cluster, distance

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        k = len(self.centroids)
        dim = np.arange(dims)
        right = np.stack([np.searchsorted(self.value[1:-1, d], x[:, d]) for d in range(dims)], 1) + 1
        left = right - 1
        seen = np.zeros((n, k), bool)
        best, number = np.full(n, _FAR), np.full(n, k)
        lane = np.arange(n)             # rows that still search
        while len(lane):
            here = x[lane]
            below = here - self.value[left, dim]
            above = self.value[right, dim] - here
            down = below <= above
            frontier = np.where(down, below, above)
            met = self.order[np.clip(np.where(down, left, right) - 1, 0, k - 1), dim]
            left, right = np.maximum(left - down, 0), np.minimum(right + ~down, k + 1)
            fresh = np.zeros((len(lane), k), bool)
            fresh[np.arange(len(lane))[:, None], met] = True
            fresh &= ~seen[lane]
            seen[lane] |= fresh
            for j in np.flatnonzero(fresh.any(0)):
                rows = np.flatnonzero(fresh[:, j])
                exact = ((here[rows] - self.centroids[j]) ** 2).sum(1)
                at = lane[rows]
                better = (exact < best[at]) | ((exact == best[at]) & (j < number[at]))
                best[at[better]], number[at[better]] = exact[better], j
            # in a list that is used up every centroid has been met
            go = ((frontier ** 2).sum(1) <= best[lane]) & ~seen[lane].all(1)
            lane, left, right = lane[go], left[go], right[go]
        return number, best


def integer_vectors(vectors: DataFrame, *, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<long>): floor(scale * x) of the vectors that are kept."""
    x = F.col(vector_col).cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                                           & (F.abs(v) * scale < float(LIMIT)))
    return (vectors.where(F.coalesce(sound, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(v * scale)).alias("vector")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(key, "vector").limit(k).collect()
    return np.array([r["vector"] for r in first], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64, copy=False)


def _sums(centroids: np.ndarray):
    """Number and sum of every cluster's vectors, one row a cluster and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                cluster, _ = lists.nearest(x)
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                total[there] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(cluster, minlength=len(count))
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(count[there]),
             pa.array(list(total[there]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = lists.nearest(_matrix(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)],
                    ["id", "cluster", "distance"])
    return run


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the cluster means; an empty cluster keeps its centroid."""
    parts = rows.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    wide = "decimal(38,0)"
    means = (parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
             .groupBy("cluster", "dim")
             .agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("part").cast(wide)).alias("total"))
             .collect())                    # k * dims rows
    out = centroids.copy()
    for r in means:
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def cluster_vectors(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64,
                    scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
                    ) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, cluster, distance) of every kept vector, and one row per centroid.

    The centroid table has cluster, centroid (array), n, cluster_inertia and
    inertia.  Vectors with another length, a null or non-finite component, or one of ``LIMIT /
    scale`` or more in size are left out; a vector without id is assigned but
    is no first centroid.  Repeated rows are vectors of their own; of equal
    distances the smaller centroid number wins; fewer than k vectors give
    fewer centroids; an empty table gives none and no rows.  Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = saved(integer_vectors(vectors, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col),
                 "integer-vectors")
    centroids = first_centroids(rows, k, seed)
    schema = "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long"
    if not len(centroids):
        empty = "id long, cluster int, distance long"
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col), spark.createDataFrame([], schema)
    for _ in range(rounds):
        moved = _moved(rows, centroids)
        if (moved == centroids).all():      # every further round would do the same
            break
        centroids = moved
    found = saved(rows.mapInArrow(_assign(centroids), "id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: (r["n"], int(r["d"])) for r in found.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    whole = sum(d for _, d in inertia.values())
    state = [(c, [int(v) for v in row], *inertia.get(c, (0, 0)), whole) for c, row in enumerate(centroids)]
    return found.withColumnRenamed("id", id_col), spark.createDataFrame(state, schema)

"""k-means jobs: bulk (E7) and staged (E8), each ending in a final assignment.

The loop state is the k centers.  Each step is one Spark job over the
persisted points (assignment, partial sums per cluster, means).  Up to
``MAX_BROADCAST_CENTERS`` come back to the driver and are broadcast; more stay a
saved DataFrame that is joined by grid cells.  The staged job writes the centers of every step as Parquet and
reads them back for the next step, so a step can be re-run from the files.
"""

from __future__ import annotations

import inspect
import math
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import clustering as km
from stepwise.plans.iterate import (
    CheckpointStore, DriverStore, IterationResult, ParquetStore, StateStore, bulk_iterate, by_rows,
)

# Points that a task compares with the centers at once (the default size of an Arrow batch).
BATCH_ROWS = 10_000


def spread(points: DataFrame, persist: bool, close: bool = False) -> tuple[DataFrame, bool]:
    """Points over at least one partition per core, persisted unless the caller did.

    The loop reads them in every step, so one shuffle of a table of few files
    pays at once.  ``close`` brings points near to each other into one batch.
    """
    if points.is_cached:
        return points, False
    cores = points.sparkSession.sparkContext.defaultParallelism
    if close:
        points = _by_place(points, max(cores, points.rdd.getNumPartitions()))
    elif points.rdd.getNumPartitions() < cores:
        points = points.repartition(cores)
    return (points.persist(StorageLevel.MEMORY_AND_DISK), True) if persist else (points, False)


def _by_place(points: DataFrame, partitions: int) -> DataFrame:
    """Points sorted by strips of x and then y, so that rows that follow each other lie close together."""
    x = F.col("x")
    box = points.where(~F.isnan(x) & (F.abs(x) < float("inf"))).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).first()
    strips = math.isqrt((box["n"] or 0) // BATCH_ROWS)
    if strips < 2 or box["high"] <= box["low"]:
        return points.repartition(partitions)
    strip = F.floor((x - F.lit(box["low"])) / F.lit((box["high"] - box["low"]) / strips))
    return (points.withColumn("__strip", strip).repartitionByRange(partitions, "__strip", "y")
            .sortWithinPartitions("__strip", "y").drop("__strip"))


def _run(points: DataFrame, centers: DataFrame, iterations: int, then: StateStore | None,
         partitions: Callable | None, persist: bool, joined: bool | None, resume: bool = False) -> IterationResult:
    start = centers.select("id", "x", "y")
    first = None if joined else km.collect_centers(start)
    boxes = first is not None and len(first) > km.MAX_UNROLLED_CENTERS
    pts, cached = spread(points if points.is_cached else points.select("x", "y"), persist, boxes)
    n_points = pts.count() if partitions is not None else None       # fills the cache
    base = pts.rdd.getNumPartitions()
    grid = km.Grid.of(pts, start) if first is None else None
    cells = km.occupied_cells(pts, grid).persist(StorageLevel.MEMORY_AND_DISK) if grid else None

    def current(state: DataFrame):
        if grid:
            return state
        return first if store.last is None else km.center_rows(store.last)

    def choose(i: int) -> int | None:
        both = len(inspect.signature(partitions).parameters) >= 2
        n = partitions(i, n_points) if both else partitions(i)
        chosen[0] = min(n, base) if n else base
        return chosen[0] if n else None

    # tasks of this step: cached partitions are merged without a shuffle, points are never reshuffled;
    # there is at least one for every core, so the number can rise again as well
    chosen = [base]
    if hasattr(partitions, "watch"):
        choose.watch = partitions.watch

    def step(state: DataFrame, i: int) -> DataFrame:
        part = pts.coalesce(chosen[0]) if chosen[0] < base else pts
        return km.kmeans_step(part, current(state), grid, cells)

    store = (then or CheckpointStore()) if grid else DriverStore(km.MAX_BROADCAST_CENTERS, then)
    res = bulk_iterate(start, step, iterations, store=store, resume=resume, name="centers",
                       partitions=choose if partitions is not None else None)
    res.extra["centers"], res.extra["grid"] = current(res.df), grid
    if cells:
        cells.unpersist()
    res.extra["points"] = pts
    res.extra["release"] = pts.unpersist if cached else (lambda: None)
    return res


def kmeans_bulk(points: DataFrame, centers: DataFrame, iterations: int = 10, *,
                partitions: Callable | None = None, persist: bool = True,
                joined: bool | None = None) -> IterationResult:
    """``iterations`` k-means steps (I1); ``df`` holds the final centers.

    ``joined`` keeps the centers a DataFrame whatever their number.  The points stay persisted for ``final_assignment``; ``extra["release"]()``
    frees them.
    """
    return _run(points, centers, iterations, None, partitions, persist, joined)


def kmeans_staged(points: DataFrame, centers: DataFrame, state_dir: str, iterations: int = 10, *,
                  partitions: Callable | None = None, adaptive_rows: int | None = None,
                  persist: bool = True, joined: bool | None = None, resume: bool = False) -> IterationResult:
    """The same steps with centers written per step.

    ``adaptive_rows`` sizes every step by ``by_rows`` over the points;
    ``partitions=Measured(spark, start)`` by the CPU use of the step before.  The
    final assignment uses the state of the last step.  ``resume`` goes on after
    the last finished step in ``state_dir``.
    """
    if adaptive_rows and partitions is None:
        partitions = by_rows(adaptive_rows)
    return _run(points, centers, iterations, ParquetStore(state_dir), partitions, persist, joined, resume)


def final_assignment(points: DataFrame, result: IterationResult,
                     out: str = "cluster") -> DataFrame:
    """E7 tail: every point with the id of its nearest final center.

    Reads the loop's persisted points when ``points`` is the loop's input.
    """
    return km.assign(points, result.extra["centers"], out, result.extra["grid"])

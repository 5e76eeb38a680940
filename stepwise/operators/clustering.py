"""k-means operators: nearest center (J8), per-cluster sums (A5), means.

The assignment has three forms by the number of centers, all exact and with the
same ties.  A few centers are folded into the plan as literals, one codegen'd
expression per point.  More, up to a checked size, are broadcast as arrays; a
batch of points is halved by its bounding box until few centers can be the
nearest one of a box.  Any number stays a DataFrame: a grid cell is joined to
the centers that can be nearest to one of its points, and points to their cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.functions.columns import distance

# Up to this many centers the assignment is an unrolled literal expression,
# whose code grows with their number.
MAX_UNROLLED_CENTERS = 100
# Most centers brought to the driver and broadcast (24 bytes each); more are joined.
MAX_BROADCAST_CENTERS = 200_000
# Distances held at once by a task, and centers or points of a box that are compared at once.
MATRIX_CELLS = 2_000_000
BOX_CENTERS, BOX_POINTS = 64, 16
_FAR = 1.7976931348623157e308   # Double.MAX_VALUE: no finite distance -> -1


def collect_centers(centers: DataFrame, limit: int | None = None) -> list[tuple[int, float, float]] | None:
    """The centers as driver-side tuples, sorted by id; None if there are more than ``limit``."""
    limit = MAX_BROADCAST_CENTERS if limit is None else limit
    start = centers.select("id", "x", "y")
    # counted first, so that too many never reach the driver
    return center_rows(start.take(limit)) if start.limit(limit + 1).count() <= limit else None


def center_rows(rows) -> list[tuple[int, float, float]]:
    """Center rows as tuples, sorted by id."""
    return sorted((int(r["id"]), float(r["x"]), float(r["y"])) for r in rows)


def nearest_center(centers: list[tuple[int, float, float]], x="x", y="y") -> Column:
    """J8 for a few centers: id of the nearest; ties go to the lowest id; -1 if none is finite."""
    if not centers:
        return F.lit(-1)
    xc, yc = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    best = F.array_min(F.array(*[
        F.struct(distance(xc, yc, F.lit(cx), F.lit(cy)).alias("d"), F.lit(cid).alias("id"))
        for cid, cx, cy in centers]))
    return F.when(best["d"] < F.lit(_FAR), best["id"]).otherwise(F.lit(-1))


def nearest_distance(centers: list[tuple[int, float, float]], x="x", y="y") -> Column:
    """P9 over all centers: distance to the nearest one (null without centers)."""
    if not centers:
        return F.lit(None).cast("double")
    xc, yc = F.col(x), F.col(y)
    return F.least(*[distance(xc, yc, F.lit(cx), F.lit(cy)) for _, cx, cy in centers]) \
        if len(centers) > 1 else distance(xc, yc, F.lit(centers[0][1]), F.lit(centers[0][2]))


def _nearest_in_boxes(x: np.ndarray, y: np.ndarray, ids: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Id of the nearest center of every point by halving boxes of points; centers are sorted by id.

    A center stays with a box if its least distance to the box is not above
    the least of all centers' greatest distances.
    """
    best = np.full(len(x), -1, np.int64)
    sound = np.isfinite(cx) & np.isfinite(cy)
    sound[sound] = np.isin(np.arange(sound.sum()), np.unique(cx[sound] + 1j * cy[sound], return_index=True)[1])
    ids, cx, cy = ids[sound], cx[sound], cy[sound]          # of equal centers the first
    start = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    todo = [(start, np.arange(len(ids)))] if len(start) and len(ids) else []
    with np.errstate(over="ignore"):
        while todo:
            rows, near = todo.pop()
            px, py, qx, qy = x[rows], y[rows], cx[near], cy[near]
            x0, x1, y0, y1 = px.min(), px.max(), py.min(), py.max()
            low_x, low_y = np.maximum(np.maximum(x0 - qx, qx - x1), 0), np.maximum(np.maximum(y0 - qy, qy - y1), 0)
            far_x, far_y = np.maximum(np.abs(qx - x0), np.abs(qx - x1)), np.maximum(np.abs(qy - y0), np.abs(qy - y1))
            # a margin far above rounding errors
            keep = low_x * low_x + low_y * low_y <= (far_x * far_x + far_y * far_y).min() * (1 + 1e-9)
            near = near[keep]
            if len(near) > BOX_CENTERS and len(rows) > BOX_POINTS and (x1 > x0 or y1 > y0):
                side = px <= x0 / 2 + x1 / 2 if x1 - x0 >= y1 - y0 else py <= y0 / 2 + y1 / 2
                if side.any() and not side.all():
                    todo += [(rows[side], near), (rows[~side], near)]
                    continue
            step = max(1, MATRIX_CELLS // len(near))
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                dx, dy = x[part, None] - cx[near], y[part, None] - cy[near]
                d = np.sqrt(dx * dx + dy * dy)
                d[~(d < _FAR)] = np.inf
                at = d.argmin(1)
                best[part] = np.where(np.isfinite(d[np.arange(len(at)), at]), ids[near[at]], -1)
    return best


def assign(points: DataFrame, centers: list[tuple[int, float, float]] | DataFrame,
           out: str = "cluster", grid: Grid | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Points with the id of their nearest center (J8); centers as a DataFrame are joined."""
    if isinstance(centers, DataFrame):
        return assign_joined(points, centers, grid or Grid.of(points, centers), out, cells)
    if len(centers) <= MAX_UNROLLED_CENTERS:
        return points.withColumn(out, nearest_center(centers))
    shared = points.sparkSession.sparkContext.broadcast(np.array(sorted(centers), dtype=np.float64))

    def run(batches):
        ids, cx, cy = shared.value.T
        for batch in batches:
            x, y = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.float64) for c in ("x", "y"))
            best = _nearest_in_boxes(x, y, ids.astype(np.int64), cx, cy).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best)], [*batch.schema.names, out])

    fields = [f for f in points.schema.fields]
    return points.mapInArrow(run, T.StructType(fields + [T.StructField(out, T.IntegerType())]))


# -- any number of centers ---------------------------------------------------

@dataclass(frozen=True)
class Grid:
    """Square cells for points and centers; level m has cells of 2 ** m times the size."""
    x0: float
    y0: float
    size: float
    levels: int

    @classmethod
    def of(cls, points: DataFrame, centers: DataFrame) -> Grid:
        """About one center to a cell of the centers' bounding box."""
        box = [f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")]
        c, p = (_finite(df).agg(F.count(F.lit(1)).alias("n"), *box).first() for df in (centers, points))
        if not c["n"] or not p["n"]:
            return cls(0.0, 0.0, 1.0, 0)
        spread = max(c["high_x"] - c["low_x"], c["high_y"] - c["low_y"])
        x0, y0 = min(c["low_x"], p["low_x"]), min(c["low_y"], p["low_y"])
        extent = max(c["high_x"], p["high_x"]) - x0, max(c["high_y"], p["high_y"]) - y0
        # cells are numbered by longs, so no more than 2 ** 40 to a side
        size = max(spread / max(1, math.isqrt(c["n"])), max(extent) * 2.0 ** -40) or 1.0
        return cls(x0, y0, size, max(0, math.ceil(math.log2(max(extent) / size + 1))) + 1)

    def cell(self, c: str, origin: float) -> Column:
        return F.floor((F.col(c) - F.lit(origin)) / F.lit(self.size))

    def cells(self, df: DataFrame) -> DataFrame:
        return df.withColumn("i", self.cell("x", self.x0)).withColumn("j", self.cell("y", self.y0))


def _finite(df: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(ok("x") & ok("y"))


def _block(level: Column) -> Column:
    """The 3 x 3 cells of a level around the cell (i, j)."""
    up = lambda c: F.expr(f"shiftright({c}, level)")
    near = F.array(*[F.struct((up("i") + a).alias("bi"), (up("j") + b).alias("bj"))
                     for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return F.explode(near).alias("block")


def cell_candidates(cells: DataFrame, centers: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, near): for every cell the centers that can be the nearest of one of its points.

    Level by level the 3 x 3 block around the cell is looked up until one has a
    center, which is then no farther than twice the block's cells in each
    direction; all centers so near lie in the block two levels up.  Of these
    stay those whose least distance to the cell is not above the least of all
    greatest distances.  All joins are shuffled: a broadcast would bring its side
    to the driver, once for every step.
    """
    spots = grid.cells(_finite(centers).groupBy("x", "y").agg(F.min("id").alias("id")))   # ties: the lowest id
    top = grid.levels + 3
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    by_level = spots.select("id", "x", "y", "i", "j", level).select(
        "id", "x", "y", "level", F.expr("shiftright(i, level)").alias("bi"), F.expr("shiftright(j, level)").alias("bj"))
    taken = by_level.select("level", "bi", "bj").distinct()
    first = (cells.select("i", "j", level).select("i", "j", "level", _block(F.col("level")))
             .select("i", "j", "level", "block.bi", "block.bj").join(taken.hint("shuffle_hash"), ["level", "bi", "bj"])
             .groupBy("i", "j").agg(F.least(F.min("level") + 2, F.lit(top)).alias("level")))
    pairs = (first.select("i", "j", "level", _block(F.col("level"))).select("i", "j", "level", "block.bi", "block.bj")
             .join(by_level.hint("merge"), ["level", "bi", "bj"]))
    margin = 1e-6 * grid.size           # above the rounding of cell numbers

    def ranges(c: str, n: str, origin: float):
        low = F.lit(origin) + F.col(n) * F.lit(grid.size) - F.lit(margin)
        high = low + F.lit(grid.size + 2 * margin)
        return (F.greatest(low - F.col(c), F.col(c) - high, F.lit(0.0)),
                F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - high)))

    (near_x, far_x), (near_y, far_y) = ranges("x", "i", grid.x0), ranges("y", "j", grid.y0)
    pairs = pairs.select("i", "j", "id", "x", "y", (near_x * near_x + near_y * near_y).alias("least"),
                         (far_x * far_x + far_y * far_y).alias("most"))
    bound = pairs.groupBy("i", "j").agg((F.min("most") * (1 + 1e-9)).alias("bound"))
    return (pairs.join(bound.hint("shuffle_hash"), ["i", "j"]).where("least <= bound")
            .groupBy("i", "j").agg(F.collect_list(F.struct("id", "x", "y")).alias("near")))


def occupied_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """(i, j) of the cells that hold points."""
    return _finite(grid.cells(points)).select("i", "j").distinct()


def assign_joined(points: DataFrame, centers: DataFrame, grid: Grid, out: str = "cluster",
                  cells: DataFrame | None = None) -> DataFrame:
    """J8 for any number of centers: points meet the candidates of their cell."""
    placed = grid.cells(points)
    near = cell_candidates(occupied_cells(points, grid) if cells is None else cells, centers, grid)
    best = F.array_min(F.transform("near", lambda c: F.struct(
        distance(F.col("x"), F.col("y"), c["x"], c["y"]).alias("d"), c["id"].alias("id"))))
    return (placed.join(near.hint("shuffle_hash"), ["i", "j"], "left")
            .withColumn("__best", best)
            .select(*points.columns, F.when(F.col("__best.d") < F.lit(_FAR), F.col("__best.id"))
                    .otherwise(F.lit(-1)).cast("int").alias(out)))


def cluster_sums(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A5 + P12: per-cluster coordinate sums and point count (map-side partial)."""
    return assigned.groupBy(F.col(cluster).alias("id")).agg(
        F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.count(F.lit(1)).alias("n"))


def cluster_means(sums: DataFrame) -> DataFrame:
    """A6 + P10: new center = sum / count; clusters without points vanish."""
    return sums.select(F.col("id").cast("int").alias("id"),
                       (F.col("sum_x") / F.col("n")).alias("x"),
                       (F.col("sum_y") / F.col("n")).alias("y"))


def kmeans_step(points: DataFrame, centers: list[tuple[int, float, float]] | DataFrame,
                grid: Grid | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One k-means step as a lazy plan: assign, sum, average."""
    return cluster_means(cluster_sums(assign(points, centers, grid=grid, cells=cells)))

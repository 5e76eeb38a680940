"""Deterministic distributed generators.

Every generated value is a function of ``(salt, row id)`` only (G7), so the
output is the same for any number of partitions and on re-execution after
a lost task; ``n`` rows are produced exactly.  Library entry points take a
count and use ``spark.range``; the ``*_for`` forms take any DataFrame with a
long ``id`` column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.functions.columns import gaussian, uniform

# Fixed values that must equal the reference generators.
DEFAULT_RANGE = 100.0        # centers lie in [-range/2, range/2)
RELATIVE_STDDEV = 0.08       # point stddev = 0.08 * range
SLOPE = 2.0                  # regression data: y = 2x + 0.01 * noise
NOISE = 0.01
MAX_MEANS = 100_000          # bound on means of a list, whose table is broadcast
MEANS_RANGE = 10_000         # ids of one range of a table of means


def seeded(salt: str, seed: int) -> str:
    """Salt of a run: seed 0 is the plain salt, every other seed its own data."""
    return f"{seed}/{salt}" if seed else salt


def ids(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Ids ``0 .. n-1`` split over ``partitions`` tasks."""
    return spark.range(0, n, 1, partitions)


def centers_for(id_df: DataFrame, salt: str = "centers", value_range: float = DEFAULT_RANGE,
                seed: int = 0) -> DataFrame:
    """G1: one uniform 2-D mean per id in ``[-range/2, range/2)`` (``id, x, y``)."""
    half, salt = value_range / 2.0, seeded(salt, seed)
    return id_df.select(
        F.col("id").cast("int").alias("id"),
        (uniform("id", salt + "x") * F.lit(value_range) - F.lit(half)).alias("x"),
        (uniform("id", salt + "y") * F.lit(value_range) - F.lit(half)).alias("y"))


def uniform_centers(spark: SparkSession, k: int, salt: str = "centers",
                    value_range: float = DEFAULT_RANGE, seed: int = 0) -> DataFrame:
    return centers_for(ids(spark, k, 1), salt, value_range, seed)


def start_centers(spark: SparkSession, k: int, value_range: float = DEFAULT_RANGE,
                  seed: int = 0) -> DataFrame:
    """A second, independent draw used as start centers."""
    return uniform_centers(spark, k, "start", value_range, seed)


def mean_weights(k: int, skew: list[int] | None) -> list[float]:
    """Probability per mean = weight / sum; equal when the list length is not k."""
    w = list(skew) if skew and len(skew) == k else [1] * k
    total = float(sum(w))
    return [x / total for x in w]


def _mean_cells(means: list[tuple[int, float, float]], probs: list[float]) -> tuple[pa.Table, int]:
    """Rows (cell, lo, hi, mx, my): the means by the equal slices of [0, 1) that
    their share of it touches, and the number of slices.

    A number u belongs to the mean with lo <= u < hi.  There are at most
    slices + means rows, however the weights are spread; the number of slices
    is a power of two, so no slice edge is rounded.
    """
    hi = np.cumsum(np.asarray(probs, np.float64))
    lo = np.concatenate(([0.0], hi[:-1]))
    hi[-1] = np.inf
    slices = 1 << (2 * len(hi) - 1).bit_length()
    first = np.floor(lo * slices).astype(np.int64)
    last = np.minimum(np.ceil(hi * slices) - 1, slices - 1).astype(np.int64)
    count = np.where(hi > lo, np.maximum(last - first + 1, 0), 0)       # a mean without weight has none
    of = np.repeat(np.arange(len(hi)), count)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    x, y = (np.array([m[j] for m in means], np.float64) for j in (1, 2))
    return pa.table({"cell": cell, "lo": lo[of], "hi": hi[of], "mx": x[of], "my": y[of]}), slices


def points_for(id_df: DataFrame, means: list[tuple[int, float, float]],
               skew: list[int] | None = None, stddev: float = RELATIVE_STDDEV,
               value_range: float = DEFAULT_RANGE, salt: str = "points", seed: int = 0) -> DataFrame:
    """G2 + G3: Gaussian points around skew-weighted means (``id, x, y``)."""
    if not means or len(means) > MAX_MEANS:
        raise ValueError("between 1 and %d means are required" % MAX_MEANS)
    sd, salt = stddev * value_range, seeded(salt, seed)
    probs = mean_weights(len(means), skew)
    cells, slices = _mean_cells(means, probs)
    # bounded by MAX_MEANS, so it is broadcast
    table = F.broadcast(id_df.sparkSession.createDataFrame(cells))
    drawn = id_df.select("id", uniform("id", salt + "c").alias("u"))
    return (drawn.withColumn("cell", F.floor(F.col("u") * F.lit(slices))).join(table, "cell")
            .where("u >= lo and u < hi")
            .select("id", (gaussian("id", salt + "x") * F.lit(sd) + F.col("mx")).alias("x"),
                    (gaussian("id", salt + "y") * F.lit(sd) + F.col("my")).alias("y")))


def points_for_table(id_df: DataFrame, means: DataFrame, stddev: float = RELATIVE_STDDEV,
                     value_range: float = DEFAULT_RANGE, salt: str = "points", seed: int = 0) -> DataFrame:
    """``points_for`` with any number of means, as a table (id, x, y, weight).

    Ids are whole numbers and weights whole numbers >= 0, one row per id.  The
    cumulative weights are sums over id ranges plus sums inside a range, and
    points meet their mean by a join on the slice of [0, 1) they fall in.
    """
    sd, salt = stddev * value_range, seeded(salt, seed)
    k, total = means.agg(F.count("*"), F.sum("weight")).first()
    if not k or not total:
        raise ValueError("at least one mean with a weight is required")
    slices = 1 << (2 * k - 1).bit_length()
    span = means.withColumn("__range", F.floor(F.col("id") / F.lit(MEANS_RANGE)))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)    # one row per range
    before = (span.groupBy("__range").agg(F.sum("weight").alias("__sum"))
              .select("__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before")))
    inside = Window.partitionBy("__range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: c.cast("double") / F.lit(float(total))
    cells = (span.withColumn("__upto", F.sum("weight").over(inside)).join(before, "__range")
             .where("weight > 0").withColumn("__upto", F.col("__upto") + F.col("__before"))
             .select(F.col("x").alias("mx"), F.col("y").alias("my"),
                     share(F.col("__upto") - F.col("weight")).alias("lo"), share(F.col("__upto")).alias("hi"))
             .withColumn("cell", F.explode(F.sequence(
                 F.floor(F.col("lo") * slices),
                 F.least(F.ceil(F.col("hi") * slices) - 1, F.lit(slices - 1))))))
    drawn = id_df.select("id", uniform("id", salt + "c").alias("u"))
    return (drawn.withColumn("cell", F.floor(F.col("u") * F.lit(slices))).join(cells, "cell")
            .where("u >= lo and u < hi")
            .select("id", (gaussian("id", salt + "x") * F.lit(sd) + F.col("mx")).alias("x"),
                    (gaussian("id", salt + "y") * F.lit(sd) + F.col("my")).alias("y")))


def kmeans_points(spark: SparkSession, n: int, k: int, skew: list[int] | None = None,
                  partitions: int | None = None, stddev: float = RELATIVE_STDDEV,
                  value_range: float = DEFAULT_RANGE, seed: int = 0) -> DataFrame:
    """Points around k uniform means; beyond ``MAX_MEANS`` the means stay a table that is joined."""
    if k < 1:
        raise ValueError("at least one mean is required")
    points = ids(spark, n, partitions)
    if k > MAX_MEANS:
        means = centers_for(ids(spark, k), value_range=value_range, seed=seed)
        if skew and len(skew) == k:
            first = means.agg(F.min("id")).first()[0]
            weights = spark.createDataFrame([(first + i, int(w)) for i, w in enumerate(skew)], "id int, weight long")
            means = means.join(weights, "id")
        else:
            means = means.withColumn("weight", F.lit(1).cast("long"))
        return points_for_table(points, means, stddev, value_range, seed=seed)
    means = [(int(r["id"]), float(r["x"]), float(r["y"]))
             for r in uniform_centers(spark, k, value_range=value_range, seed=seed).collect()]   # k rows
    return points_for(points, means, skew, stddev, value_range, seed=seed)


def samples_for(id_df: DataFrame, salt: str = "samples", seed: int = 0) -> DataFrame:
    """``x`` standard normal, ``y = 2x + 0.01 * noise`` (``id, x, y``)."""
    salt = seeded(salt, seed)
    x = gaussian("id", salt + "x")
    return id_df.select("id", x.alias("x"),
                        (F.lit(SLOPE) * x + F.lit(NOISE) * gaussian("id", salt + "y")).alias("y"))


def regression_samples(spark: SparkSession, n: int, partitions: int | None = None,
                       seed: int = 0) -> DataFrame:
    return samples_for(ids(spark, n, partitions), seed=seed)


def uniform_for(id_df: DataFrame, salt: str = "u") -> DataFrame:
    """G7 as a column over given ids (``id, u``)."""
    return id_df.select("id", uniform("id", salt).alias("u"))


def write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Generated points as ``x y`` with two decimals."""
    from stepwise.sources.text import write_formatted
    write_formatted(points, path, ["x", "y"], mode=mode)


def write_centers(centers: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Generated centers as ``id x y``; the id as a plain integer."""
    from stepwise.sources.text import write_formatted
    write_formatted(centers, path, ["x", "y"], id_col="id", mode=mode)

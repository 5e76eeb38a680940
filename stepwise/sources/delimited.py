"""Blank-separated numeric inputs: points (S5), centers (S6), samples.

Schemas are explicit, nothing is inferred.  The record converters of the
reference (S8) are plain renames and live in the schemas below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType([T.StructField("x", T.DoubleType()),
                             T.StructField("y", T.DoubleType())])
CENTER_SCHEMA = T.StructType([T.StructField("id", T.IntegerType()),
                              T.StructField("x", T.DoubleType()),
                              T.StructField("y", T.DoubleType())])
SAMPLE_SCHEMA = POINT_SCHEMA
PARAMS_SCHEMA = T.StructType([T.StructField("theta0", T.DoubleType()),
                              T.StructField("theta1", T.DoubleType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("sep", " ").option("header", "false")
            .option("mode", "FAILFAST").csv(path))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``x y`` per line."""
    return _read(spark, path, POINT_SCHEMA)


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """``id x y`` per line."""
    return _read(spark, path, CENTER_SCHEMA)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``x y`` per line."""
    return _read(spark, path, SAMPLE_SCHEMA)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """S11 read back: ``theta0 theta1``."""
    return _read(spark, path, PARAMS_SCHEMA)


"""Iteration state files (S12, S13): one explicit schema per state kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stepwise.sources.delimited import CENTER_SCHEMA, PARAMS_SCHEMA

STATE_SCHEMAS = {
    "ranks": T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("rank", T.DoubleType())]),
    "centers": CENTER_SCHEMA,
    "params": PARAMS_SCHEMA,
}


def state_path(root: str, name: str, iteration: int) -> str:
    return f"{root.rstrip('/')}/{name}/iteration_{iteration}"


def write_state(df: DataFrame, root: str, name: str, iteration: int) -> str:
    """Overwrite ``<root>/<name>/iteration_<i>`` as Parquet."""
    p = state_path(root, name, iteration)
    df.write.mode("overwrite").parquet(p)
    return p


def read_state(spark: SparkSession, root: str, name: str, iteration: int,
               kind: str | None = None) -> DataFrame:
    """Read a state back with its fixed schema."""
    schema = STATE_SCHEMAS[kind or name]
    return spark.read.schema(schema).parquet(state_path(root, name, iteration))

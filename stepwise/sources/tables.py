"""Inputs derived from the test tables (column pruning reaches the scan).

| input | derivation |
|---|---|
| PR links | lineitem ``l_partkey -> l_suppkey`` (one id space, cycles, parallel edges) |
| SINK links | orders ``o_custkey -> o_orderkey`` (orders without customers are sinks) |
| CC edges | lineitem ``l_orderkey - (1000000 + l_partkey)``, undirected |
| points | lineitem ``(l_quantity, l_extendedprice / 1000)`` |
| samples | lineitem ``(l_quantity / 50, l_extendedprice / 100000)`` |
| experiments | customer ``(c_custkey, c_mktsegment, c_name)`` |
| runs | orders ``(o_custkey, floor(o_totalprice))`` |
| CPU samples | events: job = event_type, iteration = day of year, worker = user_id mod 8, sample = value / 500 |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivations above.
PART_OFFSET = 1_000_000
POINT_Y_SCALE = 1000.0
SAMPLE_X_SCALE = 50.0
SAMPLE_Y_SCALE = 100000.0
CPU_WORKERS = 8
CPU_SCALE = 500.0
JOB_CURRENT = 4
JOB_SLOTS = 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pr_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def sink_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


def cc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed form; the components jobs make it undirected."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("src"),
                     (F.lit(PART_OFFSET) + F.col("l_partkey")).alias("dst"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("x"),
                     (F.col("l_extendedprice") / F.lit(POINT_Y_SCALE)).alias("y"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_quantity") / F.lit(SAMPLE_X_SCALE)).alias("x"),
                     (F.col("l_extendedprice") / F.lit(SAMPLE_Y_SCALE)).alias("y"))


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable long per lineitem row (``l_orderkey * 8 + l_linenumber``); rows that
    share both keys share it, and then also their generated values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * F.lit(8) + F.col("l_linenumber")).alias("id"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("suite"),
                    F.col("c_name").alias("name"))


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("experiment_id"),
                    F.floor("o_totalprice").cast("int").alias("time"))


def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("job"),
                    F.dayofyear("ts").alias("iteration"),
                    F.pmod(F.col("user_id"), F.lit(CPU_WORKERS)).cast("string").alias("worker"),
                    (F.col("value") / F.lit(CPU_SCALE)).alias("sample"))


def job_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job, current, slots)``: the event types, and the order priorities as jobs without samples."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("job")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("job")).distinct()
    return (e.unionByName(o)
            .select("job", (F.length("job") * F.lit(JOB_CURRENT)).cast("int").alias("current"),
                    F.lit(JOB_SLOTS).alias("slots")))

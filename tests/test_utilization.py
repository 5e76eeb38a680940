"""Parallelism that follows the measured CPU use of the steps."""

import time

import pytest
from pyspark.sql import functions as F

from stepwise.plans import kmeans as kmp
from stepwise.plans import pagerank as pr
from stepwise.plans.iterate import bulk_iterate
from stepwise.plans.utilization import Measured, stage_loads, utilization
from conftest import rows


def test_utilization_by_hand():
    ms = 10 ** 6                                                # CPU time is in ns
    assert utilization([], 4) is None
    assert utilization([(5, 5, 0)], 4) is None                  # no time has passed
    assert utilization([(0, 100, 200 * ms)], 4) == pytest.approx(0.5)
    # a stage inside another, one that overlaps and one after a pause: 100 + 50 + 50 ms
    loads = [(0, 100, 100 * ms), (20, 40, 20 * ms), (90, 150, 60 * ms), (200, 250, 20 * ms)]
    assert utilization(loads, 2) == pytest.approx(200 / 400)
    assert utilization([(0, 10, 100 * ms)], 1) == 1.0


def test_parallelism_rises_and_falls(spark):
    """Steps that compute, then steps that wait: tasks follow the shuffle partitions of the step."""
    def waits(batches):
        time.sleep(0.5)
        yield from batches

    def step(state, i):
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if i > 3:
            return spark.range(0, tasks, 1, tasks).mapInArrow(waits, "id long").agg((F.count("id") * 0 + i).alias("i"))
        work = F.max(F.sha2(F.sha2(F.col("id").cast("string"), 512), 512))
        found = spark.range(0, 2_000_000, 1, tasks).agg(work.alias("w"))
        return found.select((F.length("w") * 0 + i).alias("i"))     # so that the work is not pruned

    load = Measured(spark, 2, slots=4, target=0.4, minimum=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    res = bulk_iterate(spark.range(1).select(F.lit(0).alias("i")), step, 6, partitions=load)
    used = [n for _, n, _ in load.history]
    assert [i for i, *_ in load.history] == [1, 2, 3, 4, 5, 6]
    assert used[0] == 2 and max(used) > 2 and used[-1] == 1, load.history
    assert [n for *_, n in res.step_ms] == used
    # every value is the M4 proposal of the step before
    for (_, n, share), (_, following, _) in zip(load.history, load.history[1:]):
        assert following == max(1, min(4, int(share / 0.4 * n)))
    assert rows(load.report(), "iteration", "parallelism") == [(i, n) for i, n, _ in load.history]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_failed_step_is_not_measured(spark):
    load = Measured(spark, 2, minimum=1)
    with pytest.raises(ZeroDivisionError):
        bulk_iterate(spark.range(1), lambda state, i: 1 / 0, 2, partitions=load)
    assert load.history == [] and not spark.sparkContext.getJobTags()
    assert stage_loads(spark, "no-such-tag") == []


def test_measured_loops_give_the_same_rows(spark, tmp_path):
    points = spark.range(0, 5000, 1, 6).select((F.col("id") % 71).cast("double").alias("x"),
                                               (F.col("id") % 53).cast("double").alias("y"))
    centers = spark.createDataFrame([(1, 5.0, 5.0), (2, 40.0, 20.0), (3, 60.0, 50.0)], "id int, x double, y double")
    want = kmp.kmeans_bulk(points, centers, 4)
    load = Measured(spark, 2, minimum=1)
    got = kmp.kmeans_staged(points, centers, str(tmp_path / "km"), 4, partitions=load)
    assert rows(got.df, "id", "x", "y", nd=9) == rows(want.df, "id", "x", "y", nd=9)
    assert len(load.history) == 4 and all(0 <= u <= 1 for *_, u in load.history)
    for r in (want, got):
        r.extra["release"]()
    links = spark.createDataFrame([(i, (i * 7 + j) % 40) for i in range(40) for j in (1, 2, 5)], "src long, dst long")
    load = Measured(spark, 3, minimum=2)
    staged = pr.pagerank_staged(links, str(tmp_path / "pr"), max_iter=4, partitions=load)
    bulk = pr.pagerank_delta(links, max_iter=4)
    assert rows(staged.df, "id", "rank", nd=9) == rows(bulk.df, "id", "rank", nd=9)
    assert [n for _, n, _ in load.history][0] == 3 and all(n >= 2 for _, n, _ in load.history)

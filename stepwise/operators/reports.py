"""Runtime and utilization reports.

Inputs are tables: ``experiment(id, suite, name)``,
``experiment_run(experiment_id, time)`` and CPU samples
``(job, iteration, worker, sample)``.  Large inputs are pre-aggregated
before every join, so a hot experiment or worker never lands whole in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the parallelism recommender.
TARGET_UTILIZATION = 0.70
MIN_PARALLELISM = 8
# Times per range of the median.
RANGE = 65_536


def _medians(by_time: DataFrame) -> DataFrame:
    """Exact median per suite and name of ``(suite, name, time, cnt)`` rows.

    Times are cut into ranges of ``RANGE``: range counts find the range of the
    middle rows, then only its rows are ranked.  An int time has at most
    2**32 / RANGE ranges and RANGE values in each, which bounds every window.
    """
    key = ["suite", "name"]
    cell = by_time.withColumn("cell", F.floor(F.col("time") / RANGE))
    ahead = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cell.groupBy(*key, "cell").agg(F.sum("cnt").alias("k"))
             .withColumn("before", F.coalesce(F.sum("k").over(ahead), F.lit(0))))
    total = by_time.groupBy(*key).agg(F.sum("cnt").alias("n"))
    middles = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))).alias("at")
    wanted = (cells.join(total, key).select(*key, "cell", "before", "k", middles)
              .where("at >= before and at < before + k"))
    inside = Window.partitionBy(*key, "cell", "at").orderBy("time")
    ranked = (cell.join(wanted.select(*key, "cell", "before", "at"), [*key, "cell"])
              .withColumn("upto", F.col("before") + F.sum("cnt").over(inside)))
    return (ranked.where("upto > at and upto - cnt <= at")
            .groupBy(*key).agg(F.avg(F.col("time").cast("double")).alias("p50_time")))


def runtime_report(experiments: DataFrame, runs: DataFrame, suite: str | None = None) -> DataFrame:
    """M3: per suite and name the min, max, ``sum - min - max`` (``median_time``,
    the median only for exactly three runs) and the true median ``p50_time``.

    Runs are first folded to ``(experiment_id, time, count)``.
    """
    e = experiments if suite is None else experiments.where(F.col("suite") == F.lit(suite))
    freq = runs.groupBy("experiment_id", "time").agg(F.count(F.lit(1)).alias("cnt"))
    j = e.select("id", "suite", "name").join(freq, e["id"] == freq["experiment_id"])
    by_time = j.groupBy("suite", "name", "time").agg(F.sum("cnt").alias("cnt"))
    agg = by_time.groupBy("suite", "name").agg(
        F.min("time").alias("min_time"), F.max("time").alias("max_time"),
        F.sum(F.col("time").cast("long") * F.col("cnt")).alias("sum_time"))
    return agg.join(_medians(by_time), ["suite", "name"]).select(
        "suite", "name", "min_time", "max_time",
        (F.col("sum_time") - F.col("min_time") - F.col("max_time")).alias("median_time"),
        "p50_time").orderBy("suite", "name")


def cpu_averages(samples: DataFrame) -> DataFrame:
    """Per job and iteration, the mean of the per-worker mean samples.

    Workers without samples do not appear, so empty histories are skipped.
    """
    per_worker = samples.groupBy("job", "iteration", "worker").agg(
        F.avg("sample").alias("worker_avg"))
    return per_worker.groupBy("job", "iteration").agg(
        F.avg("worker_avg").alias("utilization"), F.count(F.lit(1)).alias("workers"))


def proposed_parallelism(utilization, current, slots,
                         target: float = TARGET_UTILIZATION,
                         minimum: int = MIN_PARALLELISM):
    """M4: ``int(util / target * current)``, capped at ``slots``, then raised
    to ``minimum`` (so the minimum wins over the cap); -1 without data."""
    u = F.col(utilization) if isinstance(utilization, str) else utilization
    cur, sl = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (current, slots))
    raw = F.floor((u / F.lit(target)) * cur).cast("int")
    capped = F.when(raw > sl, sl).otherwise(raw)
    raised = F.when(capped < F.lit(minimum), F.lit(minimum)).otherwise(capped)
    return F.when(u.isNull() | cur.isNull() | sl.isNull(), F.lit(-1)).otherwise(raised).cast("int")


def parallelism_proposal(samples: DataFrame, jobs: DataFrame,
                         target: float = TARGET_UTILIZATION,
                         minimum: int = MIN_PARALLELISM) -> DataFrame:
    """M4 per job and iteration from the CPU samples and the table
    ``jobs(job, current, slots)``; -1 for a job without samples or slots."""
    avg = cpu_averages(samples)
    return (jobs.select("job", "current", "slots").join(avg, "job", "left")
            .select("job", "iteration", "utilization",
                    proposed_parallelism("utilization", F.col("current"), F.col("slots"), target, minimum)
                    .alias("parallelism")))


def execution_summary(samples: DataFrame, timestamps: DataFrame | None = None,
                      jobs: DataFrame | None = None) -> DataFrame:
    """M5: per job and iteration the worker count, mean CPU and, given
    ``(job, iteration, ts)`` rows, the runtime in ms and, given ``jobs(job,
    current)``, the parallelism it ran with; plus the job's mean CPU over all
    its iterations."""
    avg = cpu_averages(samples)
    if timestamps is not None:
        rt = timestamps.groupBy("job", "iteration").agg(
            F.floor(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000)
            .cast("long").alias("runtime_ms"))
        avg = avg.join(rt, ["job", "iteration"], "left")
    overall = avg.groupBy("job").agg(F.avg("utilization").alias("job_utilization"))
    out = avg.join(overall, "job")
    if jobs is not None:
        out = out.join(jobs.select("job", F.col("current").alias("parallelism")), "job", "left")
    return out

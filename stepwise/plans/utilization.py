"""Parallelism of a superstep from the measured load of the one before."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.operators.reports import MIN_PARALLELISM, TARGET_UTILIZATION, proposed_parallelism


def stage_loads(spark: SparkSession, tag: str) -> list[tuple[int, int, int]]:
    """(start ms, end ms, CPU ns of the tasks) of every stage that ran in the jobs of a tag.

    Read from the driver's own status store; the only place of the library that
    does.  CPU time is that of the JVM, not of Python workers.
    """
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()      # the store is filled by events
    store, out = context.statusStore(), {}
    for job in context.statusTracker().getJobIdsForTag(tag):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            # the store forgets skipped stages first
            if spark.sparkContext.statusTracker().getStageInfo(stage) is None:
                continue
            data = store.lastStageAttempt(stage)
            # skipped stages have no times
            if data.submissionTime().isDefined() and data.completionTime().isDefined():
                out[stage] = (data.submissionTime().get().getTime(), data.completionTime().get().getTime(),
                              data.executorCpuTime())
    return list(out.values())


def utilization(loads: list[tuple[int, int, int]], slots: int) -> float | None:
    """Share of the time of ``slots`` slots that the stages' tasks spent on a CPU, at most 1.

    The time is that in which some stage ran; stages that overlap count once.
    None if nothing ran.
    """
    span, upto = 0, None
    for start, end, _ in sorted(loads):
        start = start if upto is None else max(start, upto)
        span += max(0, end - start)
        upto = end if upto is None else max(upto, end)
    return min(1.0, sum(cpu for *_, cpu in loads) / 1e6 / (span * slots)) if span else None


class Measured:
    """``partitions`` of a loop that follow the CPU use of its steps.

    The first step gets ``start`` partitions; after each step the M4 proposal
    from its utilization and parallelism is the parallelism of the next, so
    busy slots raise it (up to ``slots``, by default all cores) and idle ones
    lower it (down to ``minimum``, which wins over the slots).  A step that
    ran no stage leaves it as it is.  ``history`` has ``(iteration,
    parallelism, utilization)`` per step.
    """

    def __init__(self, spark: SparkSession, start: int, slots: int | None = None,
                 target: float = TARGET_UTILIZATION, minimum: int = MIN_PARALLELISM):
        self.spark, self.current = spark, start
        self.slots = slots or spark.sparkContext.defaultParallelism
        self.target, self.minimum = target, minimum
        self.history: list[tuple[int, int, float | None]] = []

    def __call__(self, i: int) -> int:
        return self.current

    @contextmanager
    def watch(self, i: int, used: int) -> Iterator[None]:
        """Measures the jobs of superstep ``i``, which runs with ``used`` partitions."""
        tag = f"stepwise-{uuid.uuid4().hex}"
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(tag)
        share = utilization(stage_loads(self.spark, tag), min(used, self.slots))
        self.history.append((i, used, share))
        if share is not None:
            self.current = self._proposal(share, used)

    def _proposal(self, share: float, used: int) -> int:
        """M4 as the report computes it, on one row."""
        column = proposed_parallelism(F.lit(share), F.lit(used), F.lit(self.slots), self.target, self.minimum)
        return self.spark.sql("SELECT 1").select(column).first()[0]

    def report(self) -> DataFrame:
        """``history`` as a table ``iteration, parallelism, utilization``."""
        return self.spark.createDataFrame(
            self.history, "iteration int, parallelism int, utilization double")

"""Linear regression jobs: bulk (E9) and staged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepwise.functions.columns import LEARNING_RATE
from stepwise.operators import regression as lr
from stepwise.plans.iterate import DriverStore, IterationResult, ParquetStore, StateStore, bulk_iterate
from stepwise.plans.kmeans import spread
from stepwise.sources.delimited import PARAMS_SCHEMA


def _run(samples: DataFrame, start: tuple[float, float], iterations: int, rate: float,
         then: StateStore | None, persist: bool, resume: bool = False) -> IterationResult:
    if start is None:
        raise ValueError("start parameters (theta0, theta1) are required")
    s, cached = spread(samples if samples.is_cached else samples.select("x", "y"), persist)

    def step(state: DataFrame, i: int) -> DataFrame:
        now = store.last[0] if store.last else state.first()       # one row
        return lr.regression_step(s, float(now["theta0"]), float(now["theta1"]), rate)

    first = samples.sparkSession.createDataFrame([tuple(map(float, start))], PARAMS_SCHEMA)
    store = DriverStore(1, then)
    try:
        res = bulk_iterate(first, step, iterations, store=store, resume=resume, name="params")
    finally:
        if cached:
            s.unpersist()
    res.extra["params"] = tuple(store.last[0] if store.last else res.df.first())
    return res


def linreg_bulk(samples: DataFrame, start: tuple[float, float], iterations: int = 10,
                rate: float = LEARNING_RATE, persist: bool = True) -> IterationResult:
    """``iterations`` gradient steps over all samples."""
    return _run(samples, start, iterations, rate, None, persist)


def linreg_staged(samples: DataFrame, start: tuple[float, float], state_dir: str,
                  iterations: int = 10, rate: float = LEARNING_RATE,
                  persist: bool = True, resume: bool = False) -> IterationResult:
    """The same steps with the parameters written per step (I4).

    ``resume`` goes on after the last finished step in ``state_dir``.
    """
    return _run(samples, start, iterations, rate, ParquetStore(state_dir), persist, resume)

"""Linear regression by batch gradient descent: P11, A7, A8.

The current parameters are one row; they enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.columns import LEARNING_RATE, gradient_step


def sample_steps(samples: DataFrame, theta0: float, theta1: float,
                 rate: float = LEARNING_RATE) -> DataFrame:
    """The parameters after one step on each single sample."""
    t0, t1 = gradient_step(F.lit(theta0), F.lit(theta1), "x", "y", rate)
    return samples.select(t0, t1)


def step_sums(steps: DataFrame) -> DataFrame:
    """Global sum of the per-sample parameters and their count."""
    return steps.agg(F.sum("theta0").alias("sum_t0"), F.sum("theta1").alias("sum_t1"),
                     F.count(F.lit(1)).alias("n"))


def averaged(sums: DataFrame) -> DataFrame:
    """New parameters = sums / count."""
    return sums.select((F.col("sum_t0") / F.col("n")).alias("theta0"),
                       (F.col("sum_t1") / F.col("n")).alias("theta1"))


def regression_step(samples: DataFrame, theta0: float, theta1: float,
                    rate: float = LEARNING_RATE) -> DataFrame:
    return averaged(step_sums(sample_steps(samples, theta0, theta1, rate)))

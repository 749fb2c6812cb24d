"""Platt calibration by Newton's method; each iteration is one aggregation."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuefit.operators.metrics import prediction_metrics


def calibrated(raw: Column, slope: float, intercept: float) -> Column:
    """M8: sigmoid(slope * raw + intercept)."""
    return 1 / (1 + F.exp(-(raw * F.lit(float(slope)) + F.lit(float(intercept)))))


def calibrate(df: DataFrame, raw: str = "value", y: str = "y", penalty: float = 1e-5, rounds: int = 80) -> tuple[float, float]:
    """M7: slope and intercept of the least mean log loss plus penalty * |theta|^2; both classes are needed."""
    rows = df.select(F.col(raw).cast("double").alias("r"), F.col(y).cast("double").alias("t")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if rows.agg(F.count_distinct("t")).first()[0] != 2:
            raise ValueError("calibration needs both classes")

        def sums(s: float, c: float) -> tuple:
            z = F.col("r") * F.lit(float(s)) + F.lit(float(c))
            p = 1 / (1 + F.exp(-z))
            h = p * (1 - p)
            loss = F.greatest(z, F.lit(0.0)) - z * F.col("t") + F.log1p(F.exp(-F.abs(z)))
            return tuple(rows.agg(F.avg(loss), F.avg((p - F.col("t")) * F.col("r")), F.avg(p - F.col("t")), F.avg(h * F.col("r") ** 2), F.avg(h * F.col("r")), F.avg(h)).first())

        theta, now = np.array([1.0, 0.0]), None
        now = sums(*theta)
        for _ in range(rounds):
            g = np.array(now[1:3]) + 2 * penalty * theta
            h = np.array([[now[3], now[4]], [now[4], now[5]]]) + 2 * penalty * np.eye(2)
            step, size = np.linalg.solve(h, g), 1.0
            before = now[0] + penalty * theta @ theta
            while True:  # damped: a step that does not lower the loss is halved
                new = theta - size * step
                found = sums(*new)
                if found[0] + penalty * new @ new <= before + 1e-15 or size < 1e-6:
                    break
                size /= 2
            theta, now = new, found
            if np.abs(size * step).max() < 1e-10:
                break
        return float(theta[0]), float(theta[1])
    finally:
        rows.unpersist()


def calibrated_metrics(val: DataFrame, test: DataFrame) -> DataFrame:
    """M8, A10: fitted on validation rows, measured on test rows."""
    slope, intercept = calibrate(val)
    return prediction_metrics(test.withColumn("value", calibrated(F.col("value"), slope, intercept)))

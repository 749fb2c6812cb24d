"""The flagship: a ridge head from distributed statistics, and its metrics by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuefit.functions.vectors import predict
from valuefit.operators import heads, metrics
from valuefit.plans.concepts import prefixes


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefixes(spark, sf_dir)
    weights = heads.fit_ridge(rows.where("split = 'train'"), 0.01)[""]
    scored = rows.select("split", "question", "y", predict(rows["x"], weights.tolist()).alias("value"))
    return metrics.prediction_metrics(scored, ["split"])

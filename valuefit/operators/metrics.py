"""Prediction metrics: question-weighted Brier scores, calibration error, baselines, areas under curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def clip01(p: Column) -> Column:
    """P16."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def question_brier(df: DataFrame, by: list[str] | None = None, value: str = "value", y: str = "y") -> DataFrame:
    """Mean squared error a question, then equal weight over questions."""
    by = by or []
    return df.groupBy(*by, "question").agg(F.avg((F.col(value) - F.col(y)) ** 2).alias("e")).groupBy(*by).agg(F.avg("e").alias("question_brier"))


def ece_bin(p: Column) -> Column:
    """The bin of a clipped prediction; edges are i / 10, the last bin is closed."""
    return reduce(lambda a, i: a.when(p < i / 10, i - 1), range(2, 10), F.when(p < 0.1, 0)).otherwise(9)


def calibration_error(df: DataFrame, by: list[str] | None = None, value: str = "value", y: str = "y") -> DataFrame:
    """Mean over rows of |mean p - mean y| of their bin."""
    by = by or []
    p = clip01(F.col(value))
    bins = df.groupBy(*by, ece_bin(p).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("m")
    )
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("m"))) / F.sum("n")).alias("ece"))


def prediction_metrics(df: DataFrame, by: list[str] | None = None, value: str = "value", y: str = "y") -> DataFrame:
    """A9, A10, A12 at once: everything is a sum by (question, bin), so one shuffle serves all metrics."""
    by = by or []
    v, t, p = F.col(value), F.col(y).cast("double"), clip01(F.col(value))
    cells = df.groupBy(*by, "question", ece_bin(p).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((v - t) ** 2).alias("se"), F.sum((p - t) ** 2).alias("ce"), F.sum(((v >= 0.5) == (t >= 0.5)).cast("double")).alias("hits"),
        F.sum(((v < 0) | (v > 1)).cast("double")).alias("out"), F.sum(p).alias("p"), F.sum(t).alias("t"),
    )
    per_q = cells.groupBy(*by, "question").agg(
        *(F.sum(c).alias(c) for c in ("n", "se", "ce", "hits", "out", "t")), F.collect_list(F.struct("bin", "n", "p", "t")).alias("bins")
    )
    in_bin = lambda i: F.filter("bins", lambda b: b["bin"] == i)
    tenth = [F.sum(F.aggregate(in_bin(i), F.lit(0.0), lambda a, b: a + b["p"] - b["t"])).alias(f"b{i}") for i in range(10)]
    n = F.sum("n")
    return per_q.groupBy(*by).agg(
        n.alias("prefixes"), F.count(F.lit(1)).alias("questions"), (F.sum("se") / n).alias("brier"), (F.sum("ce") / n).alias("clipped_brier"),
        (F.sum("hits") / n).alias("accuracy"), (F.sum("out") / n).alias("outside_unit"), (F.sum("t") / n).alias("success_rate"),
        F.avg(F.col("se") / F.col("n")).alias("question_brier"), F.avg(F.col("ce") / F.col("n")).alias("question_clipped_brier"), *tenth,
    ).withColumn("ece", reduce(lambda a, b: a + b, (F.abs(f"b{i}") for i in range(10))) / F.col("prefixes")).drop(*(f"b{i}" for i in range(10)))


def constant_baseline(train: DataFrame, test: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The training mean, by budget where ``by`` says so, scored on the test rows like a predictor."""
    prior = train.groupBy(*(by or [])).agg(F.avg(F.col("y").cast("double")).alias("value")).collect()  # one row a budget
    rows = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in [*(by or []), "value"])) for r in prior))
    return prediction_metrics(test.select("*", F.inline(rows)), by)


def majority(df: DataFrame, by: list[str]) -> DataFrame:
    """Success rate and accuracy of the majority class."""
    out = df.groupBy(*by).agg(F.avg(F.col("y").cast("double")).alias("success_rate"))
    return out.withColumn("majority_accuracy", F.greatest("success_rate", 1 - F.col("success_rate")))


def method_table(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Mean accuracy of seeds, sample deviation, seeds, and gain over the base in points (df: method, seed, score)."""
    seeds = df.groupBy("method", "seed").agg(F.avg("score").alias("accuracy"))
    out = seeds.groupBy("method").agg(
        F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("sd"), F.count(F.lit(1)).alias("seeds"),
        F.array_sort(F.collect_list(F.struct("seed", "accuracy"))).alias("by_seed"),
    )
    if base is not None:
        start = base.agg(F.avg("score")).first()[0]
        out = out.withColumn("base", F.lit(start)).withColumn("gain_pp", 100 * (F.col("accuracy") - F.col("base")))
    return out


def answer_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, questions, mean tokens and truncation rate."""
    return df.groupBy(*by).agg(
        F.avg("score").alias("accuracy"), F.count_distinct("id").alias("questions"), F.avg("response_tokens").alias("mean_tokens"),
        F.avg(F.col("capped").cast("double")).alias("truncation_rate"),
    )


def auc(df: DataFrame, by: list[str], x: str = "step", y: str = "score") -> DataFrame:
    """Trapezoids over the steps of each curve, divided by the range; null for a single step."""
    w = W.partitionBy(*by).orderBy(x)
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("part", part).groupBy(*by).agg((F.sum("part") / F.nullif(F.max(x) - F.min(x), F.lit(0))).alias("auc"))


def pick_min(df: DataFrame, by: list[str], value: str, order: str, *keep: str) -> DataFrame:
    """The row of the least value, the earliest of equals."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep, value), F.struct(value, order)).alias("b")).select(*by, "b.*")


def pick_max(df: DataFrame, by: list[str], value: str, order: str, *keep: str) -> DataFrame:
    """The row of the largest value, the smallest ``order`` of equals, and whether it is the largest of the grid."""
    top = F.max_by(F.struct(*dict.fromkeys((*keep, order, value))), F.struct(F.col(value), -F.col(order))).alias("b")
    out = df.groupBy(*by).agg(top, F.max(order).alias("ceiling"))
    return out.select(*by, "b.*", (F.col(f"b.{order}") == F.col("ceiling")).alias("at_ceiling"))


def locked_selection(per_seed: list[DataFrame]) -> DataFrame:
    """Chosen penalties of all seeds in one table, before any test row is read."""
    return reduce(lambda a, b: a.unionByName(b), per_seed)

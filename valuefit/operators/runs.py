"""Health gates, learning curves and selections over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

AUDIT = ("mse_before", "mse_after", "prediction_change", "grad_norm_max", "lr")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def audit_health(df: DataFrame, steps: int, world: int, by: list[str] | None = None) -> DataFrame:
    """Gates over (rank, update) rows of a run, all in two aggregations."""
    if not by:
        return audit_health(df.withColumn("_run", F.lit(0)), steps, world, ["_run"]).drop("_run")
    ok = _finite(AUDIT[0])
    for c in AUDIT[1:]:
        ok = ok & _finite(c)
    ranks = df.groupBy(*by, "rank").agg(
        ((F.count(F.lit(1)) == steps) & (F.count_distinct("update") == steps) & (F.min("update") == 1) & (F.max("update") == steps)).alias("whole"),
        F.bool_and(ok).alias("finite"), F.coalesce(F.bool_and(F.when(F.col("update") == 1, F.col("initial_value_abs_max") <= 1e-6)), F.lit(True)).alias("zero"),
        F.bool_and(F.coalesce(F.col("lr") > 0, F.lit(False))).alias("lr"), F.bool_or(F.coalesce((F.col("grad_norm_max") > 0) & (F.col("prediction_change") > 0), F.lit(False))).alias("moved"),
        F.sum("mse_before").alias("before"), F.sum("mse_after").alias("after"), F.count(F.lit(1)).alias("n"),
    )
    gates = ranks.groupBy(*by).agg(
        ((F.count(F.lit(1)) == world) & F.bool_and("whole")).alias("complete"), F.bool_and("finite").alias("finite"), F.bool_and("zero").alias("zero_initial_values"),
        (F.bool_and("lr") & F.bool_or("moved")).alias("nonzero_updates"), (F.bool_and("finite") & (F.sum("after") < F.sum("before"))).alias("targets_fit_better"),
        (F.sum("before") / F.sum("n")).alias("mean_mse_before"), (F.sum("after") / F.sum("n")).alias("mean_mse_after"),
    )
    seconds = df.where(F.col("update").between(1, steps)).groupBy(*by, "update").agg(F.max(F.coalesce("audit_seconds", F.lit(0.0))).alias("s"))
    seconds = seconds.groupBy(*by).agg(F.sum("s").alias("extra_seconds"))
    passed = F.col("complete") & F.col("finite") & F.col("zero_initial_values") & F.col("nonzero_updates") & F.col("targets_fit_better")
    return gates.join(seconds, by, "left").withColumn("passed", passed)


def run_summary(df: DataFrame) -> DataFrame:
    """Accounted GPU-hours: training plus both evaluations and the start on two GPUs."""
    side = F.col("initialization_seconds") + F.col("initial_seconds") + F.col("final_seconds")
    return df.withColumn("accounted_gpu_hours", F.col("training_gpu_hours") + 2 * side / 3600)


def budget_problems(df: DataFrame, per_update: int = 64) -> DataFrame:
    """(method, seed, problem) of runs whose steps are not 1..n or whose answers are not ``per_update`` a step,
    and a row of nulls if runs differ in length."""
    runs = df.groupBy("method", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("step").alias("d"), F.min("step").alias("low"), F.max("step").alias("high"), F.sum("answers").alias("answers")
    )
    reason = F.when((F.col("n") != F.col("d")) | (F.col("low") != 1) | (F.col("high") != F.col("n")), "steps").when(F.col("answers") != per_update * F.col("n"), "answers")
    own = runs.select("method", "seed", reason.alias("problem")).where("problem is not null")
    unlike = runs.agg(F.count_distinct("n").alias("k")).where("k > 1")
    return own.unionByName(unlike.select(F.lit(None).cast("string").alias("method"), F.lit(None).cast(runs.schema["seed"].dataType).alias("seed"), F.lit("length").alias("problem")))


def setting_conflicts(df: DataFrame, *settings: str) -> DataFrame:
    """Settings that are not the same in all runs."""
    row = df.agg(*(F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit(""))).alias(s) for s in settings))
    return row.select(F.inline(F.array(*(F.struct(F.lit(s).alias("setting"), F.col(s).alias("n")) for s in settings)))).where("n > 1")


def fit_log(df: DataFrame, by: list[str], per_update: int = 64) -> DataFrame:
    """Per-step fits of a run: all of ``per_update`` answers, errors finite, totals."""
    return df.groupBy(*by).agg(
        F.bool_and(F.col("answers") == per_update).alias("full"), F.bool_and(_finite("error")).alias("finite"), F.sum("fit_seconds").alias("fit_seconds"),
        F.sum("rpc_seconds").alias("rpc_seconds"), F.max("feature_bytes").alias("feature_bytes"),
    )


def encoder_epoch(step: Column, interval: int | None) -> Column:
    """(step - 1) div interval; 0 without an interval."""
    return F.lit(0) if not interval else F.floor((step - 1) / interval).cast("int")


def running_totals(df: DataFrame, by: list[str], columns: list[str], interval: int | None = None) -> DataFrame:
    """Running sums over the steps of a run, starting anew at each epoch."""
    w = W.partitionBy(*by, encoder_epoch(F.col("step"), interval)).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *(F.sum(c).over(w).alias(f"total_{c}") for c in columns))


def learning_curve(df: DataFrame, by: list[str], checkpoints: list[int], per_update: int = 64) -> DataFrame:
    """Totals at each checkpoint."""
    out = running_totals(df, by, ["response_tokens", "fit_seconds"]).where(F.col("step").isin(checkpoints))
    return out.select(*by, "step", (F.col("step") * per_update).alias("answers"), "total_response_tokens", "total_fit_seconds")


def curve_conflicts(curve: DataFrame, saved: DataFrame, by: list[str]) -> DataFrame:
    """Checkpoints at which a saved curve says something else."""
    key = [*by, "step"]
    s = saved.select(*key, F.col("total_response_tokens").alias("saved_tokens"), F.lit(True).alias("there"))
    both = curve.select(*key, "total_response_tokens", F.lit(True).alias("here")).join(s, key, "full_outer")
    return both.where("here is null or there is null or total_response_tokens <> saved_tokens").select(*key)


def mean_curves(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means over seeds at each step."""
    return df.groupBy(*by, "step").agg(*(F.avg(c).alias(c) for c in columns))


def best_epoch(df: DataFrame, by: list[str], patience: int | None = None) -> DataFrame:
    """The first epoch of the least validation Brier; with ``patience``, of the epochs before training would have
    stopped: no strict improvement for that many epochs."""
    if patience is not None:
        w = W.partitionBy(*by).orderBy("epoch")
        so_far = F.min("brier").over(w.rowsBetween(W.unboundedPreceding, -1))
        df = df.withColumn("better", F.coalesce(F.col("brier") < so_far, F.lit(True)))
        last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w.rowsBetween(W.unboundedPreceding, 0))
        df = df.withColumn("stop", (F.col("epoch") - last >= patience).cast("int"))
        stopped = F.coalesce(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        df = df.withColumn("stopped", stopped).where("stopped = 0")
    return df.groupBy(*by).agg(F.min_by("epoch", F.struct("brier", "epoch")).alias("epoch"), F.min("brier").alias("brier"))


def select_profile(df: DataFrame) -> DataFrame:
    """Of profiles that passed and did not fall below their start, the most accurate, the first declared of equals
    (profile, place, passed, initial, final); none is an error."""
    out = df.where("passed and final >= initial").orderBy(F.desc("final"), "place").limit(1)
    if out.isEmpty():
        raise ValueError("no profile passes")
    return out


def _arms(arms: DataFrame) -> tuple[Column, int]:
    """The few arms of a study as an array of (arm, pos)."""
    rows = arms.select("arm", "pos").collect()
    return F.array(*(F.struct(F.lit(r["arm"]).alias("arm"), F.lit(r["pos"]).alias("pos")) for r in rows)), len(rows)


def run_order(seeds: DataFrame, arms: DataFrame) -> DataFrame:
    """(seed, arm, place): arms rotated by the seed's position (seeds: seed, seed_pos; arms: arm, pos)."""
    rows, n = _arms(arms)
    return seeds.select("*", F.inline(rows)).select("seed", "arm", F.pmod(F.col("pos") - F.col("seed_pos"), F.lit(n)).alias("place"))


def alternating_order(seeds: DataFrame, arms: DataFrame) -> DataFrame:
    """Arms forwards for even seeds and backwards for odd ones."""
    rows, n = _arms(arms)
    place = F.when(F.col("seed") % 2 == 0, F.col("pos")).otherwise(n - 1 - F.col("pos"))
    return seeds.select("*", F.inline(rows)).select("seed", "arm", place.alias("place"))


def top_pilot(df: DataFrame) -> DataFrame:
    """The best trial of each kind by validation Brier, the first of equals."""
    return df.groupBy("kind").agg(F.min_by(F.struct("trial", "brier"), F.struct("brier", "trial")).alias("b")).select("kind", "b.trial", "b.brier")

"""Job-cost ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuefit.functions.text import gpu_count, json_digest


def known_row() -> Column:
    """Whole allocations, and array ranges that were cancelled before they got anything; steps are not."""
    whole = F.col("job_id").rlike(r"^\d+(_\d+)?$")
    unused = F.col("job_id").rlike(r"^\d+_\[[\d,%-]+\]$") & F.col("state").startswith("CANCELLED") & (F.col("elapsed").cast("double") == 0)
    return F.coalesce(whole | unused, F.lit(False))


def allocations(raw: DataFrame, check: bool = True) -> DataFrame:
    """One row an allocation with GPU- and CPU-hours; a repeated raw id is an error."""
    seconds = F.col("elapsed").cast("double")
    cpus = F.coalesce(F.nullif(F.trim("cpus"), F.lit("")).cast("int"), F.lit(0))
    out = raw.where(known_row()).select(
        "job_id", "job_id_raw", "state", seconds.alias("elapsed_seconds"), gpu_count(F.col("tres")).alias("gpus"),
        (seconds * gpu_count(F.col("tres")) / 3600).alias("gpu_hours"), (seconds * cpus / 3600).alias("cpu_hours"),
        F.try_to_timestamp("start").alias("start"), F.try_to_timestamp("end").alias("end"),
    )
    if check and out.groupBy("job_id_raw").count().where("count > 1").limit(1).count():
        raise ValueError("repeated allocation record")
    return out


def check_ledger(ledger: DataFrame) -> DataFrame:
    """Job ids are numbers and stand in one ledger only."""
    bad = ledger.groupBy("job").agg(F.count_distinct("study").alias("n")).where("n > 1 or not job rlike '^[0-9]+$'")
    if bad.limit(1).count():
        raise ValueError("a job that is no number or in several ledgers")
    return ledger


def parent_job(job_id: Column) -> Column:
    return F.substring_index(job_id, "_", 1)


def owned(ledger: DataFrame, allocs: DataFrame) -> DataFrame:
    """Allocations with the study and stage of their parent job."""
    return allocs.withColumn("job", parent_job(F.col("job_id"))).join(ledger.select("study", "stage", "job"), "job")


def missing_jobs(ledger: DataFrame, allocs: DataFrame) -> DataFrame:
    """Jobs of a ledger without any allocation."""
    return ledger.join(allocs.select(parent_job(F.col("job_id")).alias("job")).distinct(), "job", "left_anti")


def totals(df: DataFrame) -> DataFrame:
    """Allocations, GPU- and CPU-hours by study and stage, by study, and overall (nulls)."""
    return df.rollup("study", "stage").agg(F.count(F.lit(1)).alias("allocations"), F.sum("gpu_hours").alias("gpu_hours"), F.sum("cpu_hours").alias("cpu_hours"))


def zero_gpu_warnings(df: DataFrame, stages=("generate", "fit")) -> DataFrame:
    """Stages that should have had a GPU and had none."""
    return df.groupBy("study", "stage").agg(F.sum("gpu_hours").alias("gpu_hours")).where(F.col("stage").isin(*stages) & (F.col("gpu_hours") == 0))


def stage_seconds(status: DataFrame) -> DataFrame:
    """Seconds by study and stage of complete tasks (study, task, state, seconds); the stage is the task's name
    up to its last dash."""
    stage = F.regexp_replace("task", r"-[^-]*$", "")
    return status.where("state = 'complete' and seconds is not null").groupBy("study", stage.alias("stage")).agg(F.sum("seconds").alias("seconds"))


def head_resources(widths: DataFrame) -> DataFrame:
    """Bytes and ratios of two heads' systems (slim, wide: widths with intercept)."""
    s, w = F.col("slim").cast("double"), F.col("wide").cast("double")
    return widths.select(
        "slim", "wide", (8 * F.col("slim").cast("long") ** 2).cast("long").alias("slim_bytes"), (8 * F.col("wide").cast("long") ** 2).cast("long").alias("wide_bytes"),
        (s**2 / w**2).alias("storage_ratio"), (s**3 / w**3).alias("solve_ratio"),
    )


def curve_points(scores: DataFrame, usage: DataFrame) -> DataFrame:
    """Learning-curve scores (key = domain/budget/arm, brier) with the token volumes of their training subset."""
    parts = F.split("key", "/")
    keyed = scores.select(F.get(parts, F.lit(0)).alias("domain"), F.get(parts, F.lit(1)).cast("int").alias("budget"), F.get(parts, F.lit(2)).alias("arm"), "brier")
    return keyed.join(usage.where("split = 'train'").drop("split"), ["domain", "budget"])


def changed_payloads(rows: DataFrame) -> DataFrame:
    """Rows whose payload, in canonical form, has another checksum."""
    return rows.where(~json_digest(F.col("raw")).eqNullSafe(F.col("sha256")))

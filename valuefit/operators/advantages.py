"""Advantages and losses over answers' tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def gae_arrays(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """W4 on ordered arrays of one answer: A_t = r_t + gamma V_{t+1} - V_t + gamma lambda A_{t+1}, V after the end 0."""
    after = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + F.lit(gamma) * v), values, lambda a, v: a - v)
    back = F.aggregate(
        F.reverse(delta), F.array().cast("array<double>"),
        lambda acc, d: F.array_append(acc, d + F.lit(gamma * lam) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))),
    )
    return F.reverse(back)


def gae(df: DataFrame, gamma: float, lam: float, by: list[str], position: str = "position", reward: str = "reward", value: str = "value") -> DataFrame:
    """(by, position, advantage, returns) for each token.  An answer is bounded by the longest generation."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(reward).cast("double").alias("r"), F.col(value).cast("double").alias("v")))).alias("t"))
    adv = gae_arrays(F.transform("t", lambda x: x["r"]), F.transform("t", lambda x: x["v"]), gamma, lam)
    rows = rows.withColumn("a", adv).select(*by, F.explode(F.arrays_zip("t", "a")).alias("z"))
    return rows.select(*by, F.col(f"z.t.{position}").alias(position), F.col("z.a").alias("advantage"), (F.col("z.a") + F.col("z.t.v")).alias("returns"))


def whiten(df: DataFrame, by: list[str], column: str = "advantage", out: str = "whitened") -> DataFrame:
    """(A - mean) / sqrt(sample variance + 1e-8) over a batch; the two numbers a batch are joined back."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.var_samp(column).alias("_v"))
    scale = F.sqrt(F.coalesce("_v", F.lit(0.0)) + 1e-8)
    if not by:
        m, v = stats.first()
        return df.withColumn(out, (F.col(column) - F.lit(m)) / F.sqrt(F.lit(v or 0.0) + 1e-8))
    joined = df.join(stats, by)
    return joined.withColumn(out, (F.col(column) - F.col("_m")) / scale).drop("_m", "_v")


def group_advantage(df: DataFrame, by: list[str], reward: str = "reward", out: str = "advantage") -> DataFrame:
    """(r - mean) / (sample deviation + 1e-6) within a question's answers; equal rewards give 0."""
    w = W.partitionBy(*by)
    r = F.col(reward).cast("double")
    return df.withColumn(out, (r - F.avg(r).over(w)) / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + 1e-6))


def value_loss(df: DataFrame, clip: float, answer: list[str], by: list[str] | None = None) -> DataFrame:
    """Half the larger of the squared errors of the value and of the value clipped around the old one; mean by answer,
    then over answers (value, old_value, returns)."""
    clipped = F.least(F.greatest("value", F.col("old_value") - clip), F.col("old_value") + clip)
    loss = 0.5 * F.greatest((F.col("value") - F.col("returns")) ** 2, (clipped - F.col("returns")) ** 2)
    by = by or []
    return df.withColumn("l", loss).groupBy(*by, *answer).agg(F.avg("l").alias("l")).groupBy(*by).agg(F.avg("l").alias("value_loss"))


def policy_objective(df: DataFrame, clip: float, by: list[str] | None = None) -> DataFrame:
    """Mean over tokens of the clipped objective, share of clipped tokens, and mean approximate divergence
    (old_logp, new_logp, advantage)."""
    ratio = F.exp(F.col("new_logp") - F.col("old_logp"))
    held = F.least(F.greatest(ratio, F.lit(1.0 - clip)), F.lit(1.0 + clip))
    plain, cut = -ratio * F.col("advantage"), -held * F.col("advantage")
    return df.groupBy(*(by or [])).agg(
        F.avg(F.greatest(plain, cut)).alias("objective"), F.avg((cut > plain).cast("double")).alias("clip_share"), F.avg(F.col("old_logp") - F.col("new_logp")).alias("kl"),
    )


def critic_diagnostics(df: DataFrame, answer: list[str], by: list[str] | None = None) -> DataFrame:
    """Errors of values before and after against returns, mean by answer then over answers; changes by token."""
    by = by or []
    b, a, r = (F.col(c).cast("double") for c in ("before", "after", "returns"))
    per = df.groupBy(*by, *answer).agg(
        F.avg((b - r) ** 2).alias("mb"), F.avg((a - r) ** 2).alias("ma"), F.sum(F.abs(a - b)).alias("change"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs(b)).alias("top"), F.sum(r).alias("r"),
    )
    return per.groupBy(*by).agg(
        F.avg("mb").alias("mse_before"), F.avg("ma").alias("mse_after"), (F.sum("change") / F.sum("n")).alias("prediction_change"),
        F.max("top").alias("initial_value_abs_max"), (F.sum("r") / F.sum("n")).alias("target_mean"), F.count(F.lit(1)).alias("answers"),
    )

"""Answers, their prefixes, and token volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RETAINED = ("correct", "incorrect")


def explode_answers(trajectories: DataFrame) -> DataFrame:
    """One row an answer, with its number ``response`` and its fields."""
    other = [c for c in trajectories.columns if c != "responses"]
    return trajectories.select(*other, F.posexplode("responses").alias("response_index", "r")).select(
        *other, F.col("response_index").alias("response"), *(F.col(f"r.{f}").alias("response_text" if f == "response" else f) for f in _fields(trajectories))
    )


def _fields(trajectories: DataFrame) -> list[str]:
    return trajectories.schema["responses"].dataType.elementType.fieldNames()


def retained(status: Column, tokens: Column) -> Column:
    """Verifiable answers that have tokens."""
    return F.coalesce(status.isin(*RETAINED) & (tokens > 0), F.lit(False))


def explode_prefixes(answers: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """One row for each position before a token, from 0 to tokens - 1; answers without tokens have none."""
    return answers.where(F.col(tokens) > 0).withColumn("position", F.explode(F.sequence(F.lit(0), F.col(tokens).cast("int") - 1)))


def terminal_reward(position: Column, tokens: Column, outcome: Column) -> Column:
    """The outcome at the last token, 0 before."""
    return F.when(position == tokens - 1, outcome.cast("double")).otherwise(0.0)


def sample_positions(tokens: Column, key: Column, most: int = 8, seed: int = 0) -> Column:
    """Up to ``most`` positions without replacement, sorted; the same for the same seed and key, and no shuffle."""
    drawn = F.transform(
        F.sequence(F.lit(0), tokens.cast("int") - 1),
        lambda p: F.struct(F.sha2(F.concat_ws(":", F.lit(f"{seed}:prefix"), key, p.cast("string")), 256).alias("h"), p.alias("p")),
    )
    chosen = F.transform(F.slice(F.array_sort(drawn), 1, most), lambda x: x["p"])
    return F.when(tokens > 0, F.array_sort(chosen)).otherwise(F.array().cast("array<int>"))


def reward_problems(df: DataFrame) -> DataFrame:
    """Per answer of a long update table, what breaks the contract; answers in order are not listed.

    One binary reward at the last position, zeros before it, positions 0, 1, ... without gaps.
    """
    return judged_answers(df).select("step", "answer_id", "problem").where("problem is not null")


def judged_answers(df: DataFrame, *more: Column) -> DataFrame:
    """All answers of a long update table, with ``more`` about their rows and what breaks the contract, or null."""
    last = F.max("position")
    by = df.groupBy("step", "answer_id").agg(
        F.count(F.lit(1)).alias("n"), last.alias("last"), F.min("position").alias("first"), F.count_distinct("position").alias("distinct"),
        F.max_by("reward", "position").alias("terminal"), F.sum(F.abs("reward")).alias("total"), *more,
    )
    reason = (
        F.when((F.col("first") != 0) | (F.col("last") + 1 != F.col("n")) | (F.col("distinct") != F.col("n")), "positions")
        .when(~F.coalesce(F.col("terminal").isin(0.0, 1.0), F.lit(False)), "terminal_reward")
        .when(F.coalesce(F.col("total") != F.col("terminal"), F.lit(True)), "early_reward")
    )
    return by.withColumn("problem", reason)


def question_usage(answers: DataFrame, sampled: int = 8) -> DataFrame:
    """A2, first level: token volumes a question.  ``answers``: domain, split, question_id, n_tokens, n_prompt, capped,
    verifier_status."""
    keep = retained(F.col("verifier_status"), F.col("n_tokens"))
    total = lambda c: F.sum(c).cast("long")
    return answers.groupBy("domain", "split", "question_id").agg(
        F.count(F.lit(1)).alias("answers"), total("n_tokens").alias("response_tokens"), total("n_prompt").alias("prompt_tokens"),
        total(F.col("capped").cast("int")).alias("capped_answers"), total(keep.cast("int")).alias("retained_answers"),
        total(F.when(keep, F.col("n_prompt") + F.col("n_tokens")).otherwise(0)).alias("encoder_tokens"),
        total(F.when(keep, F.least("n_tokens", F.lit(sampled))).otherwise(0)).alias("sampled_prefixes"),
        F.max(keep.cast("int")).cast("long").alias("retained_question"),
    )


USAGE = ["answers", "response_tokens", "prompt_tokens", "capped_answers", "retained_answers", "encoder_tokens", "sampled_prefixes"]


def group_usage(usage: DataFrame) -> DataFrame:
    """A2, second level: by domain and split."""
    return usage.groupBy("domain", "split").agg(
        F.count(F.lit(1)).alias("questions"), *(F.sum(c).alias(c) for c in USAGE), F.sum("retained_question").alias("retained_questions")
    )


def status_counts(answers: DataFrame) -> DataFrame:
    """A1 at three levels at once: domain, split, status; domain, split; domain."""
    return answers.groupingSets([["domain", "split", "verifier_status"], ["domain", "split"], ["domain"]], "domain", "split", "verifier_status").agg(
        F.count(F.lit(1)).alias("answers")
    )


def incomplete_questions(questions: DataFrame, answers: DataFrame, expected: int) -> DataFrame:
    """A3: questions without a trajectory (answers 0) or with another number of answers than expected."""
    n = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"))
    out = questions.select(F.col("id").alias("question_id")).join(n, "question_id", "left").fillna(0, ["answers"])
    return out.where(F.col("answers") != expected)


def subset_usage(usage: DataFrame, budgets: list[int], check: bool = True) -> DataFrame:
    """A4: volumes of the first ``budget`` retained questions by id, for each domain, split and budget."""
    # Spark keeps the first ranks of each task before the shuffle, so a group sends budget rows a task at most
    rank = F.row_number().over(W.partitionBy("domain", "split").orderBy("question_id"))
    kept = usage.where("retained_question = 1").withColumn("rank", rank).where(F.col("rank") <= max(budgets))
    holds = F.explode(F.filter(F.array(*(F.lit(b) for b in budgets)), lambda b: F.col("rank") <= b)).alias("budget")
    out = kept.select("*", holds).groupBy("domain", "split", "budget").agg(F.count(F.lit(1)).alias("questions"), *(F.sum(c).cast("long").alias(c) for c in USAGE))
    if check and out.where("questions < budget").limit(1).count():
        raise ValueError("fewer retained questions than the budget asks for")
    return out

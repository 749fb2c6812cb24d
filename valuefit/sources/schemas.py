"""Schemas of the library's tables and checks that run before a plan does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTIONS = "id string, source_index long, family string, question string, reference string, prompt_token_ids array<int>, split string"
ANSWER = "token_ids array<int>, response string, capped boolean, score int, verifier_status string, extracted string"
TRAJECTORIES = f"question_id string, responses array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ANSWER.split(', '))}>>"
PREFIXES = "question string, response int, position int, x array<float>, y double"
UPDATES = "step int, answer_id string, question_id string, position int, x array<float>, reward double"
STATISTICS = "run string, fold int, step int, epoch int, a array<double>, b array<double>, transitions long, answers long"
EVALUATION = (
    "id string, level int, ground_truth string, response string, score double, response_tokens int, capped boolean, "
    "verifier_status string, extracted string"
)
ACCOUNTING = "job_id_raw string, job_id string, state string, elapsed string, cpus string, tres string, start string, end string"
LEDGER = "stage string, job string"


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """IO3: fail, by name, on a column that is not there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column: {', '.join(missing)}")
    return df


def require_none(df: DataFrame, **violations) -> DataFrame:
    """Count violations in one aggregation and fail with the names of those found."""
    row = df.agg(*(F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(True)), 1).otherwise(0)), F.lit(0)).alias(k) for k, c in violations.items())).first()
    bad = {k: row[k] for k in violations if row[k]}
    if bad:
        raise ValueError("violations: " + ", ".join(f"{k} ({n})" for k, n in bad.items()))
    return df

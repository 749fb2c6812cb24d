"""Grading of final answers by exact numbers, and score policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuefit.functions.text import boxed_parts, parse_number

# The longest answer that is graded, and statuses.
LONGEST = 32000
#: statuses that score 0 by default
ZERO = ("incorrect", "parse_failure", "unsupported_parse", "parse_timeout", "verify_timeout")
LOOSE = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def grade_numeric(df: DataFrame, response: str = "response", reference: str = "reference") -> DataFrame:
    """Adds ``extracted``, ``verifier_status`` and ``score``.

    The first box counts, without any the first number; it is compared by value, and no other candidate is tried.
    """
    text = F.col(response)
    boxes = boxed_parts(text)["boxes"]
    first = F.when(F.size(boxes) > 0, F.get(boxes, F.lit(0))).otherwise(F.nullif(F.regexp_extract(text, f"({LOOSE})", 1), F.lit("")))
    out = df.withColumn("extracted", F.when(F.length(text) <= LONGEST, first))
    value, target = parse_number(F.col("extracted")), parse_number(F.col(reference))
    status = (
        F.when(F.length(text) > LONGEST, "input_too_long").when(F.col("extracted").isNull(), "parse_failure").when(value.isNull(), "unsupported_parse")
        .when(value == target, "correct").otherwise("incorrect")
    )
    return out.withColumn("verifier_status", status).withColumn("score", (F.col("verifier_status") == "correct").cast("int"))


def grade(df: DataFrame, grade_fn: Callable[[Column, Column], Column] | None = None, response: str = "response", reference: str = "reference") -> DataFrame:
    """Grade with the numeric rule, or with a user's function of (response, reference) that gives a status."""
    if grade_fn is None:
        return grade_numeric(df, response, reference)
    out = df.withColumn("verifier_status", grade_fn(F.col(response), F.col(reference)))
    return out.withColumn("score", (F.col("verifier_status") == "correct").cast("int"))


def policy_score(status: Column, exclude: bool = False) -> Column:
    """Correct 1, others 0; when excluding, only correct and incorrect have a score.  Null: fatal, or excluded."""
    if exclude:
        return F.when(status == "correct", 1).when(status == "incorrect", 0)
    return F.when(status == "correct", 1).when(status.isin(*ZERO), 0)


def apply_policy(df: DataFrame, exclude: bool = False, reference: str = "reference") -> DataFrame:
    """Scores; a status the policy does not know, or, when excluding, an invalid reference, is an error."""
    out = df.withColumn("score", policy_score(F.col("verifier_status"), exclude))
    fatal = parse_number(F.col(reference)).isNull() if exclude else F.col("score").isNull()
    if out.where(fatal).limit(1).count():
        raise ValueError("invalid reference" if exclude else "verifier failed")
    return out


def inconsistent(df: DataFrame) -> DataFrame:
    """Rows whose score does not follow from their status."""
    want = F.when(F.col("verifier_status") == "correct", 1).when(F.col("verifier_status") == "incorrect", 0)
    return df.where(want.isNotNull() & ~want.eqNullSafe(F.col("score").cast("int")))

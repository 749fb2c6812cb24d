"""IO operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from valuefit.functions.vectors import finite
from valuefit.sources import schemas


def read_questions(spark: SparkSession, path: str, columns: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """IO1: rows of a JSON lines file; blank lines are skipped, bad ones fail.  ``columns``: new name by old name."""
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    schemas.require_columns(df, *(columns or {}))
    return df.withColumnsRenamed(columns) if columns else df


def read_subjects(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """IO2: one Parquet set for each subject, as one table with a column ``subject``."""
    frames = [spark.read.parquet(p).withColumn("subject", F.lit(s)) for s, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def online_rows(questions: DataFrame, data_source: str, instruction: str, ability: str = "math") -> DataFrame:
    """IO4: nested rows (data_source, prompt, ability, reward_model, extra_info) with their split."""
    from valuefit.functions.text import prompt_messages

    level = F.col("level").cast("int") if "level" in questions.columns else F.lit(0)
    return questions.select(
        F.lit(data_source).alias("data_source"), prompt_messages(F.col("question"), instruction).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("reference").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("source_index").alias("index"), F.col("id").alias("prompt_id"), F.col("split"), level.alias("level")).alias("extra_info"),
        F.col("split"),
    )


def write_online(questions: DataFrame, path: str, data_source: str, instruction: str, splits=("train", "val", "test")) -> None:
    """IO4: one directory a split; an empty split or an existing output is an error."""
    counts = {r["split"]: r["count"] for r in questions.groupBy("split").count().collect()}  # a row a split
    if empty := [s for s in splits if not counts.get(s)]:
        raise ValueError(f"empty split: {', '.join(empty)}")
    online_rows(questions, data_source, instruction).write.mode("errorifexists").partitionBy("split").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """IO5: evaluation answers; empty files, repeated ids, other scores than 0 and 1, or scores unlike their status fail."""
    df = spark.read.schema(schemas.EVALUATION).option("mode", "FAILFAST").json(path)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(answer_violation().cast("int")).alias("bad")).first()
    if row["n"] == 0 or row["ids"] != row["n"] or row["bad"]:
        raise ValueError(f"bad answers: {row['n']} rows, {row['ids']} ids, {row['bad']} violations")
    return df


def answer_violation() -> Column:
    """A score that is not 0 or 1 or disagrees with its status."""
    return F.coalesce(~F.col("score").isin(0, 1) | (F.col("score") != (F.col("verifier_status") == "correct").cast("int")), F.lit(True))


def write_audit(runs: dict[tuple[str, int], DataFrame], path: str) -> None:
    """IO6: all final answers as JSON lines, tagged with method and seed."""
    out = None
    for (method, seed), df in runs.items():
        df = df.withColumn("method", F.lit(method)).withColumn("seed", F.lit(seed))
        out = df if out is None else out.unionByName(df)
    out.write.mode("errorifexists").json(path)


def read_features(spark: SparkSession, *paths: str, width: int | None = None) -> DataFrame:
    """IO7: feature shards of one split; empty, non-finite or ragged vectors, or a single class, fail."""
    return check_features(spark.read.parquet(*paths), width)


def check_features(df: DataFrame, width: int | None = None) -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"),
        F.sum((~finite(F.col("x"))).cast("int")).alias("bad"), F.sum((~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).cast("int")).alias("labels"),
    ).first()
    if row["n"] == 0 or row["bad"] or row["labels"] or row["least"] != row["most"] or row["low"] == row["high"] or (width and row["least"] != width):
        raise ValueError(f"bad features: {row.asDict()}")
    return df


def coverage(df: DataFrame, *by: str) -> DataFrame:
    """IO8: questions, prefixes and share of correct ones."""
    return df.groupBy(*by).agg(
        F.count_distinct("question").alias("questions"), F.count(F.lit(1)).alias("prefixes"), F.avg(F.col("y").cast("double")).alias("correct")
    )


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    """IO9: a scheduler's export: fields between bars, no header."""
    df = spark.read.schema(schemas.ACCOUNTING).csv(path, sep="|", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.where("job_id_raw is not null")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """IO9: stage and job, between tabs."""
    return spark.read.schema(schemas.LEDGER).csv(path, sep="\t").select("stage", F.trim("job").alias("job"))


def read_wrapped(spark: SparkSession, path: str, payload_schema: str) -> DataFrame:
    """IO10: files of {payload, sha256}: the payload as raw JSON (``raw``) and parsed (``payload``), and its checksum."""
    whole = spark.read.text(path, wholetext=True)
    raw = F.get_json_object("value", "$.payload")
    return whole.select(
        raw.alias("raw"), F.from_json(raw, payload_schema).alias("payload"), F.get_json_object("value", "$.sha256").alias("sha256"),
        F.input_file_name().alias("file"),
    )


def read_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """IO11: metric lines of all ranks; ``rank`` is the number in the file name, null without one."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df.withColumn("rank", F.nullif(F.regexp_extract(F.input_file_name(), r"rank-(\d+)[^/]*$", 1), F.lit("")).cast("int"))


def write_predictions(df: DataFrame, path: str, by=("domain", "budget", "arm", "seed")) -> None:
    """IO12: question, position, label and value, one directory a run."""
    df.select(*by, "question", "position", "y", "value").write.partitionBy(*by).mode("errorifexists").parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of text files that are not blank, numbered from 0 by file name and place in the file.

    Tasks count the lines of their parts of files; how many lines come before a part is a running sum over the parts (a row
    each), and a line's place in its part is its distance from the part's first line.  The lines themselves are not moved.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", *place).withColumn("id", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(parts, ["file", "start"]).select((F.col("before") + F.col("id") - F.col("first")).alias("ordinal"), "value")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """IO13: states to score, numbered in the order of the files' lines."""
    schema = "question string, prefix string, prefix_token_ids array<int>"
    return numbered_lines(spark, path).select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("s")).select("ordinal", "s.*")


def state_violation() -> Column:
    """P20: a state needs a question and either prefix text or non-negative token ids."""
    ids, text = F.col("prefix_token_ids"), F.col("prefix")
    good = (F.trim("question") != "") & (text.isNull() != ids.isNull())
    good = good & (ids.isNull() | F.forall(ids, lambda v: v.isNotNull() & (v >= 0)))
    return ~F.coalesce(good, F.lit(False))


def write_corpus(questions: DataFrame, path: str) -> None:
    """IO14: the offline training corpus, problem, answer and solution, as JSON lines."""
    questions.select("problem", "answer", "solution").write.mode("errorifexists").json(path)

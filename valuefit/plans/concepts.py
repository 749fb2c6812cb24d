"""The library's concepts as views of the benchmark tables, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuefit.functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("source_index"), F.col("text").alias("question"), "lang", "source", t.family_key("text").alias("family"),
        F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_tokens"),
    )


SQL_FAMILY = r"trim(regexp_replace(regexp_replace(lower({}), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*', ' NUMBER ', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
SQL_QUESTIONS = f"""q AS (SELECT doc_id AS source_index, text AS question, lang, source, {SQL_FAMILY.format("text")} AS family,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_tokens FROM documents)"""


def split_of(key: Column) -> Column:
    """A split by the hash of a key."""
    h = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(h < 6, "train").when(h < 8, "val").otherwise("test")


def sql_split(key: str) -> str:
    h = f"(('0x' || substr(sha256(({key})::VARCHAR), 1, 8))::BIGINT % 10)"
    return f"CASE WHEN {h} < 6 THEN 'train' WHEN {h} < 8 THEN 'val' ELSE 'test' END"


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix features: embeddings as vectors, y = label >= 5, ten vectors a question, in five answers."""
    e = table(spark, sf_dir, "embeddings")
    q = F.floor(F.col("vec_id") / 10)
    return e.select(
        q.cast("string").alias("question"), (F.col("vec_id") % 5).cast("int").alias("response"), F.col("vec_id").alias("position"),
        F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("double").alias("y"), split_of(q).alias("split"),
        (F.col("label") % 2).cast("string").alias("domain"),
    )


SQL_PREFIXES = f"""p AS (SELECT (vec_id // 10)::VARCHAR AS question, (vec_id % 5)::INTEGER AS response, vec_id AS position,
  embedding::DOUBLE[] AS x, (label >= 5)::INTEGER::DOUBLE AS y, {sql_split("vec_id // 10")} AS split, (label % 2)::VARCHAR AS domain FROM embeddings)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: turns of conversations; tokens are words, the status follows conversation and turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    s = (F.col("conv_id") + F.col("turn")) % 5
    return c.select(
        F.concat(F.lit("d"), F.col("conv_id") % 2).alias("domain"), split_of(F.col("conv_id")).alias("split"), F.col("conv_id").cast("string").alias("question_id"),
        F.col("turn").cast("int").alias("response"), n.alias("n_tokens"), (F.col("conv_id") % 7 + 1).cast("int").alias("n_prompt"), (n >= 40).alias("capped"),
        F.when(s < 2, "correct").when(s < 4, "incorrect").otherwise("parse_failure").alias("verifier_status"),
    )


SQL_ANSWERS = f"""a AS (SELECT 'd' || (conv_id % 2) AS domain, {sql_split("conv_id")} AS split, conv_id::VARCHAR AS question_id, turn::INTEGER AS response,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_tokens, (conv_id % 7 + 1)::INTEGER AS n_prompt,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 40 AS capped,
  CASE WHEN (conv_id + turn) % 5 < 2 THEN 'correct' WHEN (conv_id + turn) % 5 < 4 THEN 'incorrect' ELSE 'parse_failure' END AS verifier_status
  FROM conversations)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token tables: one answer for each user and event type; values are scaled, the reward is 0/1 at the end."""
    from pyspark.sql.window import Window as W

    e = table(spark, sf_dir, "events")
    by = W.partitionBy("user_id", "event_type")
    pos = F.row_number().over(by.orderBy("ts", "event_id")) - 1
    last = pos == F.count(F.lit(1)).over(by) - 1
    return e.select(
        F.col("user_id").alias("question"), F.concat_ws("-", "user_id", "event_type").alias("answer"), pos.alias("position"),
        (F.col("value") / 100).alias("value"), F.when(last, F.col("user_id") % 2).otherwise(0).cast("double").alias("reward"), F.col("event_id"),
    )


SQL_EPISODES = """e AS (SELECT user_id AS question, user_id || '-' || event_type AS answer,
  row_number() OVER w - 1 AS position, value / 100 AS value,
  CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id, event_type) THEN user_id % 2 ELSE 0 END::DOUBLE AS reward, event_id
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers of runs: method by priority, seed by customer, id by part, checkpoint by line number."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.substring("o_orderpriority", 1, 1).alias("method"), (F.col("o_custkey") % 3).cast("int").alias("seed"), F.col("l_partkey").alias("id"),
        (F.col("l_quantity") > 25).cast("double").alias("score"), F.col("l_linenumber").cast("int").alias("step"), F.col("l_partkey").alias("response_tokens"),
        (F.col("l_tax") > 0.05).alias("capped"), F.col("l_discount").alias("fit_seconds"),
    )


SQL_SCORES = """s AS (SELECT substr(o_orderpriority, 1, 1) AS method, (o_custkey % 3)::INTEGER AS seed, l_partkey AS id,
  (l_quantity > 25)::INTEGER::DOUBLE AS score, l_linenumber::INTEGER AS step, l_partkey AS response_tokens, l_tax > 0.05 AS capped,
  l_discount AS fit_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
METHODS = ["1", "2", "3", "4", "5"]


def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduler's export made of orders: tasks of array jobs of fifteen orders, steps, and cancelled ranges; every tenth
    job never ran."""
    o = table(spark, sf_dir, "orders").where("floor(o_orderkey / 15) % 10 <> 9")
    k = F.col("o_orderkey")
    job = F.concat(F.floor(k / 15).cast("string"), F.when(k % 5 == 0, ".batch").when(k % 11 == 0, "_[0-4]").otherwise(F.concat(F.lit("_"), k.cast("string"))))
    tres = F.when(k % 4 == 0, "cpu=8,gres/gpu=2,gres/gpu:a=1").when(k % 4 == 1, "cpu=4,gres/gpu:a=1,gres/gpu:b=2").when(k % 4 == 2, "cpu=4")
    return o.select(
        k.cast("string").alias("job_id_raw"), job.alias("job_id"), F.when(k % 11 == 0, "CANCELLED by 1").otherwise("COMPLETED").alias("state"),
        F.when(k % 11 == 0, F.lit("0")).otherwise(F.floor("o_totalprice").cast("string")).alias("elapsed"),
        F.when(k % 3 == 0, "").otherwise("8").alias("cpus"), tres.alias("tres"), F.col("o_orderdate").cast("string").alias("start"), F.lit("Unknown").alias("end"),
    )


SQL_ACCOUNTING = """acc AS (SELECT o_orderkey::VARCHAR AS job_id_raw,
  (o_orderkey // 15)::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN '.batch' WHEN o_orderkey % 11 = 0 THEN '_[0-4]' ELSE '_' || o_orderkey END AS job_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'CANCELLED by 1' ELSE 'COMPLETED' END AS state,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice) END::DOUBLE AS elapsed,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 8 END AS cpus, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS gpus FROM orders WHERE (o_orderkey // 15) % 10 <> 9),
al AS (SELECT *, string_split(job_id, '_')[1] AS job, elapsed * gpus / 3600 AS gpu_hours, elapsed * cpus / 3600 AS cpu_hours FROM acc
  WHERE regexp_full_match(job_id, '[0-9]+(_[0-9]+)?') OR (regexp_full_match(job_id, '[0-9]+_\\[[0-9,%-]+\\]') AND starts_with(state, 'CANCELLED') AND elapsed = 0))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of two studies, one for fifteen orders."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 15).alias("j")).distinct()
    stage = F.when(F.col("j") % 3 == 0, "generate").when(F.col("j") % 3 == 1, "fit").otherwise("evaluate")
    return o.select(F.concat(F.lit("s"), F.col("j") % 2).alias("study"), stage.alias("stage"), F.col("j").cast("string").alias("job"))


SQL_LEDGER = """led AS (SELECT DISTINCT 's' || (j % 2) AS study, CASE j % 3 WHEN 0 THEN 'generate' WHEN 1 THEN 'fit' ELSE 'evaluate' END AS stage, j::VARCHAR AS job
  FROM (SELECT o_orderkey // 15 AS j FROM orders))"""

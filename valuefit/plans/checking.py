"""Queries of whole curation paths, accounting of runs, and comparisons of saved tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuefit.functions import text as t
from valuefit.operators import curate, heads, metrics, paired, prefixes, runs, stats
from valuefit.plans import concepts as c
from valuefit.plans.concepts import SQL_ANSWERS, SQL_FAMILY, SQL_PREFIXES, SQL_QUESTIONS, SQL_SCORES, r6, table
from valuefit.plans.evaluating import SQL_LOG
from valuefit.plans.solving import SQL_SOLVE, sql_systems


def _tagged(spark, sf_dir):
    """Documents as problems with metadata; solutions have one box, two, none that closes, or one without a number."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    box = F.when(k % 4 == 0, F.concat(F.lit("\\boxed{"), k, F.lit("}"))).when(k % 4 == 1, F.lit("\\boxed{1}\\fbox{2}")).when(k % 4 == 2, F.lit("\\boxed{3")).otherwise("\\boxed{x}")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    valid = F.when(k % 7 == 5, F.lit(None)).when(k % 7 == 6, "No").otherwise("Yes")
    return d.select(
        k.alias("source_index"), F.col("text").alias("problem"), box.alias("solution"), F.when(k % 12 == 0, "5").otherwise(k.cast("string")).alias("answer"), n.alias("n_tokens"),
        F.when(F.col("lang") == "de", "other").otherwise("cn_k12").alias("source"), F.when(k % 11 == 3, F.lit(None)).otherwise(k % 11 == 4).alias("synthetic"),
        F.lit("math-word-problem").alias("question_type"), valid.alias("problem_is_valid"), F.lit("Yes").alias("solution_is_valid"),
    )


MANY = r"(?i)(?:find|enter|give|list|determine)\s+all\s+(?:the\s+)?(?:possible\s+)?(?:values|solutions|roots)|separated\s+by\s+commas"
SQL_TAGGED = rf"""{SQL_QUESTIONS}, r AS (SELECT *, source_index % 4 AS m, regexp_matches(question, '{MANY}') AS many FROM q),
g AS (SELECT *, nullif(concat_ws('|', CASE WHEN m = 2 THEN 'malformed_reference_box' END, CASE WHEN m IN (1, 2) THEN 'reference_must_have_exactly_one_box' END,
  CASE WHEN m <> 0 THEN 'reference_not_single_decimal' END, CASE WHEN many THEN 'question_requests_multiple_answers' END,
  CASE WHEN source_index % 12 = 0 THEN 'saved_reference_mismatch' END), '') AS wrong FROM r)"""


def tagged_questions(spark, sf_dir):
    blocked = table(spark, sf_dir, "benchmark").select(t.family_key("text").alias("family")).unionByName(_tagged(spark, sf_dir).where("source_index % 40 = 8").select(t.family_key("problem").alias("family")))
    return curate.prepare_tagged(_tagged(spark, sf_dir), blocked, 300).select("source_index", "reason")


def general_questions(spark, sf_dir):
    q = _tagged(spark, sf_dir).withColumnRenamed("problem", "question")
    return curate.prepare_questions(q, 300, 300, 560, "solution", keep=("number",)).select("source_index", "number", "reason")


def usable_references(spark, sf_dir):
    good, bad = curate.eligible_rows(_tagged(spark, sf_dir).drop("answer"))
    bad = bad.select("source_index", F.lit(None).cast("string").alias("reference"), F.array_join("reasons", "|").alias("reasons"))
    return good.select("source_index", "reference", F.lit(None).cast("string").alias("reasons")).unionByName(bad)


def boxed_corpus(spark, sf_dir):
    rows = _tagged(spark, sf_dir).withColumn("source", F.when(F.col("source_index") % 5 == 0, " GSM8K ").otherwise("src"))
    return curate.normalise_rows(rows, "boxed").select("source_index", "answer", "reason")


def exploded_answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("response")))).alias("responses")
    )
    out = prefixes.explode_answers(turns)
    return out.select("conv_id", F.col("response").cast("long").alias("response"), "turn", "role", F.md5("response_text").alias("text"))


def merged_usage(spark, sf_dir):
    u = prefixes.question_usage(c.answers(spark, sf_dir))
    a, b = u.where("domain = 'd0'"), u.where("domain <> 'd0'")
    curate.require_disjoint(a, b, "question_id")
    return curate.merge_usage(a, b, "question_id").select("domain", "question_id", "answers", "response_tokens")


def accounted_hours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("training_gpu_hours"), (F.col("o_orderkey") % 60).alias("initialization_seconds"),
        (F.col("o_orderkey") % 70).alias("initial_seconds"), (F.col("o_custkey") % 80).alias("final_seconds"),
    )
    return runs.run_summary(o).select("o_orderkey", r6("accounted_gpu_hours").alias("accounted_gpu_hours"))


def seed_statistics(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "step", "seed").agg(F.avg("score").alias("score"))
    return paired.seed_statistics(s, ["method", "step"], "score").select("method", "step", r6("mean").alias("mean"), r6("sd").alias("sd"), "seeds")


def fit_log(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "seed", "step").agg(F.sum("fit_seconds").alias("fit_seconds"), F.max("response_tokens").alias("feature_bytes"), F.avg("score").alias("error"))
    s = s.withColumn("answers", F.when((F.col("method") == "2") & (F.col("step") == 4), 63).otherwise(64)).withColumn("rpc_seconds", F.col("fit_seconds") / 4)
    s = s.withColumn("error", F.when((F.col("method") == "3") & (F.col("seed") == 1) & (F.col("step") == 2), F.lit(float("nan"))).otherwise(F.col("error")))
    return runs.fit_log(s, ["method", "seed"]).select("method", "seed", "full", "finite", r6("fit_seconds").alias("fit_seconds"), r6("rpc_seconds").alias("rpc_seconds"), "feature_bytes")


def setting_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("adam").alias("optimizer"), F.col("o_orderpriority").alias("schedule"), F.nullif("o_orderstatus", F.lit("P")).alias("policy"))
    return runs.setting_conflicts(o, "optimizer", "schedule", "policy")


def _totals(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    log = s.groupBy("method", "seed", "step").agg(F.sum("response_tokens").alias("response_tokens"), F.sum("fit_seconds").alias("fit_seconds"))
    return runs.learning_curve(log, ["method", "seed"], [1, 3, 5, 7])


def curve_conflicts(spark, sf_dir):
    curve = _totals(spark, sf_dir)
    saved = curve.where("not (method = '2' and step = 3)").withColumn("total_response_tokens", F.col("total_response_tokens") + F.when((F.col("seed") == 1) & (F.col("step") == 5), 1).otherwise(0))
    return runs.curve_conflicts(curve, saved, ["method", "seed"])


def alternating_order(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    return runs.alternating_order(s.select("seed").distinct(), s.select(F.col("method").alias("arm"), (F.col("method").cast("int") - 1).alias("pos")).distinct())


def locked_penalties(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("seed", "method", "step").agg(F.round(F.avg("score"), 2).alias("score"))
    s = s.select("seed", "method", F.pow(F.lit(10.0), F.col("step") - 3).alias("epsilon"), F.col("step").alias("place"), "score")
    return metrics.locked_selection([metrics.pick_min(s.where(F.col("seed") == k), ["seed", "method"], "score", "place", "epsilon") for k in range(3)])


def policy_reports(spark, sf_dir):
    """Both penalty policies on the system of each split; the report's numbers that SQL can say from the system itself."""
    p = c.prefixes(spark, sf_dir)
    rows = []
    for split, s in stats.collect_statistics(stats.ridge_partials(p, "split")).items():
        for policy in ("legacy", "relative"):
            epsilon = heads.regularisation(s["a"], policy, 1e-3)
            report = heads.policy_report(s["a"], s["b"], epsilon)
            rows.append((split, policy, report["epsilon"], report["norm"]))
    out = spark.createDataFrame(rows, "split string, policy string, epsilon double, norm double")  # two rows a split
    return out.select("split", "policy", r6("epsilon").alias("epsilon"), r6("norm").alias("norm"))


SQL = {
    "tagged_questions": rf"""WITH {SQL_TAGGED}, b AS (SELECT {SQL_FAMILY.format("text")} AS family FROM benchmark UNION SELECT family FROM q WHERE source_index % 40 = 8),
e AS (SELECT source_index, family, CASE WHEN lang = 'de' OR source_index % 11 IN (3, 4) OR source_index % 7 IN (5, 6) THEN 'source_or_metadata'
  WHEN regexp_matches(question, '(?i)!\[|\\includegraphics|https?://|\b(?:diagram|figure|shown below|prove that)\b') THEN 'non_text_or_proof'
  WHEN wrong IS NOT NULL THEN wrong WHEN family IN (SELECT family FROM b) THEN 'overlap_or_duplicate' END AS early,
  CASE WHEN n_tokens = 0 OR n_tokens > 300 THEN 'prompt_length' END AS late FROM g),
f AS (SELECT family, min(source_index) AS first_index FROM e WHERE early IS NULL AND late IS NULL GROUP BY 1)
SELECT source_index, CASE WHEN early IS NOT NULL THEN early WHEN source_index > first_index THEN 'overlap_or_duplicate' ELSE late END AS reason FROM e LEFT JOIN f USING (family)""",
    "general_questions": rf"""WITH {SQL_TAGGED}, n AS (SELECT *, CASE WHEN source_index % 12 = 0 THEN '5' ELSE source_index::VARCHAR END AS number FROM g),
e AS (SELECT source_index, family, number, CASE WHEN NOT regexp_matches(question, '\S') THEN 'empty_question' WHEN wrong IS NOT NULL THEN 'reference_audit'
  WHEN regexp_matches(question, '(?i)!\[|https?://|\[asy\]|\\includegraphics|<img|\bdiagram\b|\bfigure\b') THEN 'diagram' WHEN many THEN 'multiple_answers' END AS early,
  CASE WHEN n_tokens = 0 OR n_tokens > 300 THEN 'prompt_length' WHEN n_tokens + 300 > 560 THEN 'native_context' END AS late FROM n),
f AS (SELECT family, min(source_index) AS first_index FROM e WHERE early IS NULL AND late IS NULL GROUP BY 1)
SELECT source_index, number, CASE WHEN early IS NOT NULL THEN early WHEN source_index > first_index THEN 'duplicate_family' ELSE late END AS reason FROM e LEFT JOIN f USING (family)""",
    "usable_references": f"""WITH {SQL_TAGGED.replace("source_index % 12 = 0", "false")} SELECT source_index, CASE WHEN wrong IS NULL THEN source_index::VARCHAR END AS reference, wrong AS reasons FROM g""",
    "boxed_corpus": f"""WITH {SQL_TAGGED.replace("source_index % 12 = 0", "false")} SELECT source_index, CASE WHEN m = 0 THEN source_index::VARCHAR END AS answer,
  CASE WHEN source_index % 5 = 0 THEN 'held_out_source_tag' ELSE wrong END AS reason FROM g""",
    "exploded_answers": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS response, turn, role, md5(text) AS text FROM conversations",
    "merged_usage": f"WITH {SQL_ANSWERS} SELECT domain, question_id, count(*) AS answers, sum(n_tokens)::BIGINT AS response_tokens FROM a GROUP BY 1, 2",
    "accounted_hours": "SELECT o_orderkey, round(o_totalprice / 1000 + 2 * (o_orderkey % 60 + o_orderkey % 70 + o_custkey % 80) / 3600, 6) AS accounted_gpu_hours FROM orders",
    "seed_statistics": f"""WITH {SQL_SCORES}, a AS (SELECT method, step, seed, avg(score) AS a FROM s GROUP BY 1, 2, 3)
SELECT method, step, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS sd, count(*) AS seeds FROM a GROUP BY 1, 2""",
    "fit_log": f"""WITH {SQL_SCORES}, a AS (SELECT method, seed, step, sum(fit_seconds) AS f, max(response_tokens) AS b FROM s GROUP BY 1, 2, 3)
SELECT method, seed, bool_and(NOT (method = '2' AND step = 4)) AS full, bool_and(NOT (method = '3' AND seed = 1 AND step = 2)) AS finite, round(sum(f), 6) AS fit_seconds,
  round(sum(f / 4), 6) AS rpc_seconds, max(b) AS feature_bytes FROM a GROUP BY 1, 2""",
    "setting_conflicts": """SELECT 'schedule' AS setting, count(DISTINCT o_orderpriority) AS n FROM orders HAVING n > 1
UNION ALL SELECT 'policy', count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END) AS n FROM orders HAVING n > 1""",
    "curve_conflicts": f"WITH {SQL_LOG} SELECT method, seed, step FROM l WHERE (method = '2' AND step = 3) OR (seed = 1 AND step = 5)",
    "alternating_order": f"""WITH {SQL_SCORES}, a AS (SELECT DISTINCT method AS arm, method::INTEGER - 1 AS pos FROM s)
SELECT seed, arm, (CASE WHEN seed % 2 = 0 THEN pos ELSE (SELECT count(*) FROM a) - 1 - pos END)::INTEGER AS place FROM (SELECT DISTINCT seed FROM s), a""",
    "locked_penalties": f"""WITH {SQL_SCORES}, g AS (SELECT seed, method, step, round(avg(score), 2) AS score FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, method ORDER BY score, step) AS r FROM g) SELECT seed, method, 10.0::DOUBLE ** (step - 3) AS epsilon, score FROM r WHERE r = 1""",
    "policy_reports": f"""WITH RECURSIVE {SQL_PREFIXES}, tr AS (SELECT split, greatest(0.01::DOUBLE, 1e-3::DOUBLE * (sum(list_inner_product(x, x)) + count(*)) / 65) AS t FROM p GROUP BY 1),
f AS (SELECT split || '/' || policy AS key, x, y, CASE policy WHEN 'legacy' THEN 0.01::DOUBLE ELSE t END AS epsilon FROM p JOIN tr USING (split), (VALUES ('legacy'), ('relative')) v(policy)),
{sql_systems("f")}, {SQL_SOLVE}
SELECT split_part(key, '/', 1) AS split, split_part(key, '/', 2) AS policy, round(any_value(epsilon), 6) AS epsilon, round(sqrt(list_inner_product(any_value(w), any_value(w))), 6) AS norm FROM sol JOIN f USING (key) GROUP BY key""",
}
QUERIES = {f.__name__: f for f in (
    tagged_questions, general_questions, usable_references, boxed_corpus, exploded_answers, merged_usage, accounted_hours, seed_statistics, fit_log, setting_conflicts,
    curve_conflicts, alternating_order, locked_penalties, policy_reports,
)}

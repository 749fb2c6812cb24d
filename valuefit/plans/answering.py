"""Queries of functions, answers, prefixes and token volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuefit.functions import text as t
from valuefit.operators import curate, grading, prefixes
from valuefit.plans.concepts import SQL_ANSWERS, answers, r6, table
from valuefit.sources.tables import online_rows


def parse_number_canonical(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit(" +"), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit("-00"), k.cast("string"), F.lit(".500")))
        .when(k % 6 == 2, F.format_number(k, 0)).when(k % 6 == 3, F.concat(k.cast("string"), F.lit(",00"))).when(k % 6 == 4, F.lit("-0.00"))
        .otherwise(F.concat(F.lit("0."), k.cast("string"), F.lit("00 ")))
    )
    return o.select("o_orderkey", t.parse_number(raw).alias("number"))


def tres_gpu_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tres = F.when(k % 3 == 0, F.concat(F.lit("cpu=8,gres/gpu="), k % 7)).when(k % 3 == 1, F.concat(F.lit("gres/gpu:a="), k % 4, F.lit(",gres/gpu:b="), k % 5)).when(k % 3 == 2, "cpu=8,mem=4G")
    return o.select("o_orderkey", t.gpu_count(tres).alias("gpus"))


def prompt_struct(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("source_index"), F.col("text").alias("question"), F.lit("7").alias("reference"), F.lit("test").alias("split"))
    rows = online_rows(b, "made", "Answer.")
    good = t.prompt_ok(F.col("prompt"), ["Answer."])
    return rows.select(F.col("extra_info.prompt_id").alias("id"), F.size("prompt").alias("messages"), F.get("prompt", F.lit(1))["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), good.alias("ok"))


def completion_prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", t.completion_prompt(F.col("text"), "Think, then answer.").alias("prompt"))


def after_marker(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat("role", F.when(F.col("turn") % 3 == 0, " #### 4").when(F.col("turn") % 3 == 1, " #### 5 #### 6").otherwise(" none"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", t.after_marker(text).alias("answer"))


def capped_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tokens = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 6 + 1).cast("int")), lambda i: ((F.col("event_id") * i) % 5).cast("int"))
    e = e.select("event_id", tokens.alias("tokens"))
    return e.select("event_id", t.capped(F.col("tokens"), 6, 0).alias("capped"), F.size(t.cut_at_end(F.col("tokens"), 0)).alias("cut"))


def status_score_policy(spark, sf_dir):
    a = answers(spark, sf_dir)
    out = a.select("question_id", "response", "verifier_status", grading.policy_score(F.col("verifier_status")).alias("score"), grading.policy_score(F.col("verifier_status"), True).alias("strict"))
    return out.groupBy("verifier_status").agg(F.sum("score").alias("score"), F.sum("strict").alias("strict"), F.count("strict").alias("scored"), F.count(F.lit(1)).alias("n_rows"))


def grade_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    response = F.when(k % 4 == 0, F.concat(F.lit("so \\boxed{"), k, F.lit(".0}"))).when(k % 4 == 1, F.concat(F.lit("it is "), k, F.lit(" or 2"))).when(k % 4 == 2, F.lit("\\boxed{x}")).otherwise("no idea")
    rows = o.select(k.alias("id"), response.alias("response"), F.when(k % 3 == 0, k + 1).otherwise(k).cast("string").alias("reference"))
    return grading.grade(rows).select("id", "verifier_status", "score", "extracted")


def boxed_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    solution = F.when(k % 4 == 0, F.concat(F.substring("text", 1, 20), F.lit(" \\boxed{"), k, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit("\\boxed{1}\\fbox{2} "), "text")).when(k % 4 == 2, F.lit("\\boxed{3")).otherwise(F.concat(F.lit("\\boxed{a{b}c} "), "text"))
    out = d.select("doc_id", t.reference_decision(F.col("text"), solution, F.lit("8")).alias("r"))
    return out.select("doc_id", "r.eligible", F.array_join("r.reasons", "|").alias("reasons"), F.array_join("r.reference_boxes", ";").alias("boxes"), "r.number")


def retained_answers(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.where(prefixes.retained(F.col("verifier_status"), F.col("n_tokens"))).select("question_id", "response", "n_tokens")


def prefix_explode(spark, sf_dir):
    p = prefixes.explode_prefixes(answers(spark, sf_dir))
    p = p.withColumn("reward", prefixes.terminal_reward(F.col("position"), F.col("n_tokens"), F.col("verifier_status") == "correct"))
    return p.groupBy("question_id", "response").agg(F.count(F.lit(1)).alias("prefixes"), F.sum("position").alias("positions"), F.sum("reward").alias("reward"), F.max_by("reward", "position").alias("terminal"))


def prefix_sample_hash(spark, sf_dir):
    a = answers(spark, sf_dir)
    pos = prefixes.sample_positions(F.col("n_tokens"), F.concat_ws(":", "question_id", "response"), 8, 1)
    return a.select("question_id", "response", F.explode(pos).alias("position"))


def token_usage(spark, sf_dir):
    return prefixes.group_usage(prefixes.question_usage(answers(spark, sf_dir)))


def question_usage(spark, sf_dir):
    return prefixes.question_usage(answers(spark, sf_dir))


def status_counts(spark, sf_dir):
    return prefixes.status_counts(answers(spark, sf_dir))


def completeness_check(spark, sf_dir):
    a = answers(spark, sf_dir)
    known = a.select((F.col("question_id").cast("long") * 2).cast("string").alias("id")).distinct()
    return prefixes.incomplete_questions(known, a, 4)


def subset_usage(spark, sf_dir):
    return prefixes.subset_usage(prefixes.question_usage(answers(spark, sf_dir)), [1, 5, 20], check=False)


def prompt_limits(spark, sf_dir):
    a = answers(spark, sf_dir)
    kept, over = curate.overlong_prompts(a, F.col("n_tokens"), 60, True)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(over).cast("long").alias("dropped"))


def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.count(F.lit(1)).alias("n_rows"), r6(F.avg(F.length("props"))).alias("mean_length"))


USAGE = """count(*) AS answers, sum(n_tokens)::BIGINT AS response_tokens, sum(n_prompt)::BIGINT AS prompt_tokens, sum(capped::INT)::BIGINT AS capped_answers,
  sum(k)::BIGINT AS retained_answers, sum(k * (n_prompt + n_tokens))::BIGINT AS encoder_tokens, sum(k * least(n_tokens, 8))::BIGINT AS sampled_prefixes,
  max(k)::BIGINT AS retained_question"""
SQL_USAGE = f"""{SQL_ANSWERS}, k AS (SELECT *, (verifier_status IN ('correct', 'incorrect') AND n_tokens > 0)::INT AS k FROM a),
u AS (SELECT domain, split, question_id, {USAGE} FROM k GROUP BY 1, 2, 3)"""
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in prefixes.USAGE)
SQL = {
    "parse_number_canonical": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '-' || o_orderkey || '.5' WHEN 2 THEN o_orderkey::VARCHAR
  WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE '0.' || regexp_replace(o_orderkey::VARCHAR, '0+$', '') END AS number FROM orders""",
    "tres_gpu_count": "SELECT o_orderkey, (CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 7 WHEN 1 THEN o_orderkey % 4 + o_orderkey % 5 ELSE 0 END)::INTEGER AS gpus FROM orders",
    "prompt_struct": "SELECT item_id::VARCHAR AS id, 2 AS messages, text AS content, '7' AS ground_truth, true AS ok FROM benchmark",
    "completion_prompts": """SELECT item_id, 'Think, then answer.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM benchmark""",
    "after_marker": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '4' || turn END AS answer FROM conversations",
    "capped_flag": """WITH t AS (SELECT event_id, list_transform(generate_series(1, event_id % 6 + 1), lambda i: (event_id * i) % 5) AS k FROM events)
SELECT event_id, len(k) = 6 AND k[-1] <> 0 AS capped, (CASE WHEN list_contains(k, 0) THEN list_position(k, 0) ELSE len(k) END)::INTEGER AS cut FROM t""",
    "status_score_policy": f"""WITH {SQL_ANSWERS} SELECT verifier_status, sum((verifier_status = 'correct')::INT)::BIGINT AS score,
  sum(CASE verifier_status WHEN 'correct' THEN 1 WHEN 'incorrect' THEN 0 END)::BIGINT AS strict, count(*) FILTER (verifier_status IN ('correct', 'incorrect')) AS scored, count(*) AS n_rows FROM a GROUP BY 1""",
    "grade_numbers": r"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS m, o_orderkey % 3 = 0 AS off FROM orders)
SELECT id, CASE m WHEN 2 THEN 'unsupported_parse' WHEN 3 THEN 'parse_failure' ELSE CASE WHEN off THEN 'incorrect' ELSE 'correct' END END AS verifier_status,
  (m < 2 AND NOT off)::INT AS score, CASE m WHEN 0 THEN id || '.0' WHEN 1 THEN id::VARCHAR WHEN 2 THEN 'x' END AS extracted FROM r""",
    "boxed_references": r"""WITH d AS (SELECT doc_id, doc_id % 4 AS m, regexp_matches(text, '(?i)(?:find|enter|give|list|determine)\s+all\s+(?:the\s+)?(?:possible\s+)?(?:values|solutions|roots)|separated\s+by\s+commas') AS many FROM documents),
e AS (SELECT doc_id, m, concat_ws('|', CASE WHEN m = 2 THEN 'malformed_reference_box' END, CASE WHEN m IN (1, 2) THEN 'reference_must_have_exactly_one_box' END,
  CASE WHEN m <> 0 THEN 'reference_not_single_decimal' END, CASE WHEN many THEN 'question_requests_multiple_answers' END, CASE WHEN m = 0 AND doc_id <> 8 THEN 'saved_reference_mismatch' END) AS reasons FROM d)
SELECT doc_id, reasons = '' AS eligible, reasons, CASE m WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '1;2' WHEN 2 THEN '' ELSE 'a{b}c' END AS boxes, CASE WHEN m = 0 THEN doc_id::VARCHAR END AS number FROM e""",
    "retained_answers": f"WITH {SQL_ANSWERS} SELECT question_id, response, n_tokens::INTEGER AS n_tokens FROM a WHERE verifier_status IN ('correct', 'incorrect') AND n_tokens > 0",
    "prefix_explode": f"""WITH {SQL_ANSWERS} SELECT question_id, response, n_tokens AS prefixes, (n_tokens * (n_tokens - 1) // 2)::BIGINT AS positions,
  (verifier_status = 'correct')::INT::DOUBLE AS reward, (verifier_status = 'correct')::INT::DOUBLE AS terminal FROM a WHERE n_tokens > 0""",
    "prefix_sample_hash": f"""WITH {SQL_ANSWERS}, x AS (SELECT question_id, response, unnest(generate_series(0, n_tokens - 1)) AS position FROM a WHERE n_tokens > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, response ORDER BY sha256('1:prefix:' || question_id || ':' || response || ':' || position), position) AS r FROM x)
SELECT question_id, response, position::INTEGER AS position FROM r WHERE r <= 8""",
    "question_usage": f"WITH {SQL_USAGE} SELECT * FROM u",
    "token_usage": f"WITH {SQL_USAGE} SELECT domain, split, count(*) AS questions, {SUMS}, sum(retained_question)::BIGINT AS retained_questions FROM u GROUP BY 1, 2",
    "status_counts": f"WITH {SQL_ANSWERS} SELECT domain, split, verifier_status, count(*) AS answers FROM a GROUP BY GROUPING SETS ((domain, split, verifier_status), (domain, split), (domain))",
    "completeness_check": f"""WITH {SQL_ANSWERS}, n AS (SELECT question_id, count(*) AS answers FROM a GROUP BY 1), k AS (SELECT DISTINCT (question_id::BIGINT * 2)::VARCHAR AS question_id FROM a)
SELECT question_id, coalesce(answers, 0) AS answers FROM k LEFT JOIN n USING (question_id) WHERE coalesce(answers, 0) <> 4""",
    "subset_usage": f"""WITH {SQL_USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY domain, split ORDER BY question_id) AS r FROM u WHERE retained_question = 1)
SELECT domain, split, budget, count(*) AS questions, {SUMS} FROM r JOIN (VALUES (1), (5), (20)) b(budget) ON r <= budget GROUP BY 1, 2, 3""",
    "prompt_limits": f"WITH {SQL_ANSWERS} SELECT count(*) FILTER (n_tokens <= 60) AS kept, count(*) FILTER (n_tokens > 60) AS dropped FROM a",
    "json_fields": "SELECT event_type, count(json_extract_string(props, '$.k')) AS with_k, count(*) AS n_rows, round(avg(length(props)), 6) AS mean_length FROM events GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (
    parse_number_canonical, tres_gpu_count, prompt_struct, completion_prompts, after_marker, capped_flag, status_score_policy, grade_numbers, boxed_references, retained_answers, prefix_explode,
    prefix_sample_hash, question_usage, token_usage, status_counts, completeness_check, subset_usage, prompt_limits, json_fields,
)}

"""Queries of curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuefit.functions import text as t
from valuefit.operators import curate
from valuefit.plans.concepts import SQL_ANSWERS, SQL_FAMILY, SQL_PREFIXES, SQL_QUESTIONS, answers, prefixes, questions, table
from valuefit.sources.tables import coverage

EARLY = {"empty_question": lambda: curate.blank(F.col("question")), "diagram": lambda: curate.diagram(F.col("question")),
         "multiple_answers": lambda: curate.many_answers(F.col("question"))}
LATE = {"prompt_length": lambda: curate.prompt_too_long(F.col("n_tokens"), 400), "native_context": lambda: curate.context_too_long(F.col("n_tokens"), 300, 640)}


SQL_EARLY = r"""CASE WHEN NOT regexp_matches(question, '\S') THEN 'empty_question'
  WHEN regexp_matches(question, '(?i)!\[|https?://|\[asy\]|\\includegraphics|<img|\bdiagram\b|\bfigure\b') THEN 'diagram'
  WHEN regexp_matches(question, '(?i)(?:find|enter|give|list|determine)\s+all\s+(?:the\s+)?(?:possible\s+)?(?:values|solutions|roots)|separated\s+by\s+commas') THEN 'multiple_answers' END"""
SQL_MARKED = f"""{SQL_QUESTIONS}, e AS (SELECT *, {SQL_EARLY} AS early,
  CASE WHEN NOT (n_tokens > 0 AND n_tokens <= 400) THEN 'prompt_length' WHEN n_tokens + 300 > 640 THEN 'native_context' END AS late FROM q),
f AS (SELECT family, min(source_index) AS first_index FROM e WHERE early IS NULL AND late IS NULL GROUP BY family),
m AS (SELECT e.*, CASE WHEN early IS NOT NULL THEN early WHEN source_index > first_index THEN 'duplicate_family' ELSE late END AS reason, first_index
  FROM e LEFT JOIN f USING (family))"""


def first_reason_counts(spark, sf_dir):
    q = questions(spark, sf_dir)
    marked = curate.eligible_reasons(q, {k: c() for k, c in EARLY.items()}, {k: c() for k, c in LATE.items()})
    return marked.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def family_dedup(spark, sf_dir):
    q = questions(spark, sf_dir)
    out = curate.mark_duplicates(q, F.col("n_tokens").between(1, 340))
    return out.select("source_index", "first_index", "duplicate")


def all_reasons(spark, sf_dir):
    q = questions(spark, sf_dir)
    checks = {"long": F.col("n_tokens") > 200, "held_out": curate.held_out_source(F.col("source"), ("src1", "src2")), "digits": F.col("question").rlike("[0-9]"), "not_text": curate.not_text(F.col("question"))}
    return q.groupBy(F.coalesce(curate.all_reasons(checks), F.lit("none")).alias("reasons")).agg(F.count(F.lit(1)).alias("n_rows"))


def blocked_anti_join(spark, sf_dir):
    q = questions(spark, sf_dir)
    blocked = curate.block_list(q.where("source = 'src0'"), table(spark, sf_dir, "benchmark").select(t.family_key("text").alias("family")))
    return curate.exclude_families(q.where("source <> 'src0'"), blocked).select("source_index", "source")


def hash_order_topn(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("id", F.sha2("family", 256)).groupBy("id").agg(F.min("source_index").alias("source_index"))
    return curate.top_by_hash(q, 100, 42).select("source_index", "id", t.order_key(42, F.col("id")).alias("order_key"))


def salted_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", t.salted_key("salt-v1", F.col("c_name")).alias("order_key"), t.hash_seed(F.col("c_name")).alias("seed"))


def split_60_20_20(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return curate.split_share(d, 42)


def budget_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return curate.split_counts(d, {"train": 100, "val": 20, "test": 60}, t.order_key("b", F.col("id")), "id")


def fold_assignment(spark, sf_dir):
    return curate.two_folds(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), 7)


def split_overlap_check(spark, sf_dir):
    q = questions(spark, sf_dir).select("family", F.col("source_index").alias("id"), F.col("lang").alias("split"))
    blocked = table(spark, sf_dir, "benchmark").select(t.family_key("text").alias("family"))
    return curate.split_problems(q, blocked, {"en": 10, "xx": 5})


def whitespace_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("question"), "source")
    both = curate.exact_overlap(d.where("source <= 'src15'"), d.where("source > 'src15'"))
    return both.select(F.sha2("text", 256).alias("text_sha256"))


def first_per_split(spark, sf_dir):
    q = questions(spark, sf_dir).select("family", "source_index", F.col("lang").alias("split"))
    return curate.first_per_split(q, {"en": 40, "fr": 20}, q.where("source_index < 20")).select("split", "source_index")


def nested_budgets(spark, sf_dir):
    out = curate.nested_budgets(prefixes(spark, sf_dir), [5, 20, 50])
    return out.groupBy("budget").agg(F.count(F.lit(1)).alias("prefixes"), F.count_distinct("question").alias("questions"), F.sum("y").alias("positives"))


def pool_two_domains(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    out = curate.pool_two(p.where("domain = '0'"), p.where("domain = '1'"), 21, 3)
    return out.groupBy("domain", "question").agg(F.count(F.lit(1)).alias("prefixes"))


def coverage_by_split(spark, sf_dir):
    return coverage(prefixes(spark, sf_dir), "domain", "split").withColumn("correct", F.round("correct", 6))


def semi_join_questions(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("source_index"))
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"), "lang")
    return curate.keep_questions(q, chosen, "source_index")


def missing_ids(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select("doc_id")
    return curate.missing_ids(known, table(spark, sf_dir, "labels"), "doc_id")


def attach_questions(spark, sf_dir):
    a = answers(spark, sf_dir).select("question_id", "response", "verifier_status")
    q = a.groupBy(F.col("question_id").alias("id")).agg(F.max("response").alias("last"))
    return curate.attach_questions(a, q)


def answer_ledger(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), F.sha2("text", 256).alias("content"))
    return curate.new_answers(c, c.where(F.substring(F.md5("key"), 1, 1) < "5")).select("key")


def normalised_corpora(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("so #### "), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" apples"))).otherwise(F.concat(k.cast("string"), F.lit(" #### 2"))))
    out = curate.normalise_rows(o.select(k.alias("source_index"), F.lit("q").alias("question"), text.alias("answer")), "marker")
    return out.select("source_index", "answer", "reason")


SQL = {
    "answer_ledger": "SELECT conv_id || '/' || turn AS key FROM conversations WHERE substr(md5(conv_id || '/' || turn), 1, 1) >= '5'",
    "first_reason_counts": f"WITH {SQL_MARKED} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n_rows FROM m GROUP BY 1",
    "family_dedup": f"""WITH {SQL_QUESTIONS}, f AS (SELECT family, min(source_index) AS first_index FROM q WHERE n_tokens BETWEEN 1 AND 340 GROUP BY 1)
SELECT source_index, first_index, coalesce(source_index > first_index, false) AS duplicate FROM q LEFT JOIN f USING (family)""",
    "all_reasons": rf"""WITH {SQL_QUESTIONS}, r AS (SELECT concat_ws('|', CASE WHEN n_tokens > 200 THEN 'long' END, CASE WHEN lower(trim(source)) IN ('src1', 'src2') THEN 'held_out' END,
  CASE WHEN regexp_matches(question, '[0-9]') THEN 'digits' END,
  CASE WHEN regexp_matches(question, '(?i)!\[|\\includegraphics|https?://|\b(?:diagram|figure|shown below|prove that)\b') THEN 'not_text' END) AS r FROM q)
SELECT CASE WHEN r = '' THEN 'none' ELSE r END AS reasons, count(*) AS n_rows FROM r GROUP BY 1""",
    "blocked_anti_join": f"""WITH {SQL_QUESTIONS}, b AS (SELECT family FROM q WHERE source = 'src0' UNION SELECT {SQL_FAMILY.format("text")} FROM benchmark)
SELECT source_index, source FROM q WHERE source <> 'src0' AND family NOT IN (SELECT family FROM b)""",
    "hash_order_topn": f"""WITH {SQL_QUESTIONS}, i AS (SELECT sha256(family) AS id, min(source_index) AS source_index FROM q GROUP BY 1)
SELECT source_index, id, sha256('42:' || id) AS order_key FROM i ORDER BY order_key, id LIMIT 100""",
    "salted_order": """SELECT c_custkey, sha256('["salt-v1","' || c_name || '"]') AS order_key, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT AS seed FROM customer""",
    "split_60_20_20": """WITH r AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id::VARCHAR) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT id, CASE WHEN r < floor(0.6::DOUBLE * n) THEN 'train' WHEN r < floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""",
    "budget_split": """WITH r AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY sha256('b:' || doc_id), doc_id::VARCHAR) - 1 AS r FROM documents)
SELECT id, CASE WHEN r < 100 THEN 'train' WHEN r < 120 THEN 'val' ELSE 'test' END AS split FROM r WHERE r < 180""",
    "fold_assignment": """SELECT id, ((row_number() OVER (ORDER BY sha256('7:' || id), id) - 1) % 2)::INTEGER AS fold FROM (SELECT DISTINCT user_id::VARCHAR AS id FROM events)""",
    "split_overlap_check": f"""WITH {SQL_QUESTIONS}, g AS (SELECT family, count(*) AS n, count(DISTINCT lang) AS s FROM q GROUP BY 1)
SELECT 'family_in_several_splits' AS problem, count(*) AS n FROM g WHERE s > 1 UNION ALL SELECT 'repeated_family', count(*) FROM g WHERE n > 1
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT source_index FROM q GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'blocked_family', count(*) FROM q WHERE family IN (SELECT {SQL_FAMILY.format("text")} FROM benchmark)
UNION ALL SELECT 'short_en', greatest(10 - count(*), 0) FROM q WHERE lang = 'en' UNION ALL SELECT 'short_xx', greatest(5 - count(*), 0) FROM q WHERE lang = 'xx'""",
    "whitespace_overlap": r"""WITH d AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, source FROM documents)
SELECT sha256(text) AS text_sha256 FROM (SELECT text FROM d WHERE source <= 'src15' INTERSECT SELECT text FROM d WHERE source > 'src15')""",
    "first_per_split": f"""WITH {SQL_QUESTIONS}, b AS (SELECT DISTINCT family FROM q WHERE source_index < 20),
en AS (SELECT family, min(source_index) AS source_index FROM q WHERE lang = 'en' AND family NOT IN (SELECT family FROM b) GROUP BY 1 ORDER BY 2 LIMIT 40),
fr AS (SELECT family, min(source_index) AS source_index FROM q WHERE lang = 'fr' AND family NOT IN (SELECT family FROM b UNION SELECT family FROM en) GROUP BY 1 ORDER BY 2 LIMIT 20)
SELECT 'en' AS split, source_index FROM en UNION ALL SELECT 'fr', source_index FROM fr""",
    "nested_budgets": f"""WITH {SQL_PREFIXES}, o AS (SELECT question, row_number() OVER (ORDER BY question) AS r FROM (SELECT DISTINCT question FROM p))
SELECT budget, count(*) AS prefixes, count(DISTINCT question) AS questions, sum(y) AS positives
FROM p JOIN o USING (question) JOIN (VALUES (5), (20), (50)) b(budget) ON r <= budget GROUP BY 1""",
    "pool_two_domains": f"""WITH {SQL_PREFIXES}, a AS (SELECT question FROM (SELECT DISTINCT question FROM p WHERE domain = '0') ORDER BY sha256('3:a:' || question), question LIMIT 11),
b AS (SELECT question FROM (SELECT DISTINCT question FROM p WHERE domain = '1') ORDER BY sha256('3:b:' || question), question LIMIT 10)
SELECT domain, question, count(*) AS prefixes FROM p WHERE (domain = '0' AND question IN (SELECT question FROM a)) OR (domain = '1' AND question IN (SELECT question FROM b)) GROUP BY 1, 2""",
    "coverage_by_split": f"WITH {SQL_PREFIXES} SELECT domain, split, count(DISTINCT question) AS questions, count(*) AS prefixes, round(avg(y), 6) AS correct FROM p GROUP BY 1, 2",
    "semi_join_questions": "SELECT doc_id AS source_index, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "missing_ids": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "normalised_corpora": """SELECT o_orderkey AS source_index, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey || ' apples' END AS answer,
  CASE o_orderkey % 3 WHEN 1 THEN 'not_decimal' WHEN 2 THEN 'no_single_marker' END AS reason FROM orders""",
}
SQL |= {
    "attach_questions": f"""WITH {SQL_ANSWERS} SELECT question_id, response, verifier_status, max(response) OVER (PARTITION BY question_id) AS last FROM a""",
}
QUERIES = {f.__name__: f for f in (
    first_reason_counts, family_dedup, all_reasons, blocked_anti_join, hash_order_topn, salted_order, split_60_20_20, budget_split, fold_assignment, split_overlap_check,
    whitespace_overlap, first_per_split, nested_budgets, pool_two_domains, coverage_by_split, semi_join_questions, missing_ids, attach_questions, answer_ledger, normalised_corpora,
)}

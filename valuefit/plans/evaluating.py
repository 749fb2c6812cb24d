"""Queries of advantages, run comparison, learning curves, gates and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuefit.operators import advantages, ledger, metrics, paired, prefixes, runs
from valuefit.plans import concepts as c
from valuefit.plans.concepts import METHODS, SQL_ACCOUNTING, SQL_ANSWERS, SQL_EPISODES, SQL_LEDGER, SQL_SCORES, r6, table


# --- advantages ----------------------------------------------------------------------------------------------------


def _gae(spark, sf_dir):
    return advantages.gae(c.episodes(spark, sf_dir), 0.9, 0.8, ["answer"])


def gae_returns(spark, sf_dir):
    return _gae(spark, sf_dir).select("answer", F.col("position").cast("long").alias("position"), r6("advantage").alias("advantage"), r6("returns").alias("returns"))


def whitened_advantage(spark, sf_dir):
    e = c.episodes(spark, sf_dir).withColumn("advantage", F.col("reward") - F.col("value")).withColumn("batch", F.col("question") % 3)
    return advantages.whiten(e, ["batch"]).select("event_id", "batch", r6("whitened").alias("whitened"))


def group_advantage(spark, sf_dir):
    e = c.episodes(spark, sf_dir).groupBy("question", "answer").agg(F.max(F.when(F.col("value") > 1, 1.0).otherwise(0.0)).alias("reward"))
    return advantages.group_advantage(e, ["question"]).select("question", "answer", "reward", r6("advantage").alias("advantage"))


def value_loss(spark, sf_dir):
    e = c.episodes(spark, sf_dir).select("question", "answer", "value", (F.col("value") * 0.5).alias("old_value"), (F.col("question") % 2).cast("double").alias("returns"), (F.col("question") % 3).alias("batch"))
    return advantages.value_loss(e, 0.2, ["answer"], ["batch"]).select("batch", r6("value_loss").alias("value_loss"))


def policy_objective(spark, sf_dir):
    e = c.episodes(spark, sf_dir).select((F.col("question") % 3).alias("batch"), (F.col("value") * 0.01).alias("new_logp"), (F.col("value") * F.lit(-0.2)).alias("old_logp"), (F.col("reward") - 0.3).alias("advantage"))
    out = advantages.policy_objective(e, 0.2, ["batch"])
    return out.select("batch", *(r6(x).alias(x) for x in ("objective", "clip_share", "kl")))


def critic_diagnostics(spark, sf_dir):
    e = c.episodes(spark, sf_dir).select((F.col("question") % 3).alias("batch"), "answer", (F.col("value") * 0.1).alias("before"), (F.col("value") * 0.3).alias("after"), (F.col("question") % 2).cast("double").alias("returns"))
    out = advantages.critic_diagnostics(e, ["answer"], ["batch"])
    return out.select("batch", "answers", *(r6(x).alias(x) for x in ("mse_before", "mse_after", "prediction_change", "initial_value_abs_max", "target_mean")))


def reward_contract(spark, sf_dir):
    e = c.episodes(spark, sf_dir).select(F.lit(1).alias("step"), F.col("answer").alias("answer_id"), F.col("position").cast("int").alias("position"), "reward", "event_id")
    e = e.where("event_id % 97 <> 0").withColumn("reward", F.when(F.col("event_id") % 89 == 0, 0.5).otherwise(F.col("reward")))
    return prefixes.reward_problems(e)


# --- runs ----------------------------------------------------------------------------------------------------------


def method_table(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    out = metrics.method_table(s, s.where("step = 1"))
    return out.select("method", "seeds", *(r6(x).alias(x) for x in ("accuracy", "sd", "gain_pp")))


def answer_summary(spark, sf_dir):
    out = metrics.answer_summary(c.scores(spark, sf_dir), ["method", "seed"])
    return out.select("method", "seed", "questions", *(r6(x).alias(x) for x in ("accuracy", "mean_tokens", "truncation_rate")))


def paired_differences(spark, sf_dir):
    out = paired.differences(c.scores(spark, sf_dir), METHODS)
    return out.groupBy("pair").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("delta")).alias("mean"), r6(F.stddev_samp("delta")).alias("sd"))


def bootstrap_interval(spark, sf_dir):
    s = c.scores(spark, sf_dir).where("method in ('1', '2')")
    both = s.groupBy("seed", "id").agg(F.count_distinct("method").alias("m")).where("m = 2").groupBy("id").count().where("count = 3").select("id")
    out = paired.compare(s.join(both, "id", "left_semi"), "1", "2", draws=1000)
    return out.select(*(r6(x).alias(x) for x in ("low", "high", "mean")))


def poisson_interval(spark, sf_dir):
    d = paired.differences(c.scores(spark, sf_dir), ["1", "2"], keys=("id",))
    out = paired.interval(paired.poisson_draws(d, 500, 3), comparisons=2)
    return out.select(*(r6(x).alias(x) for x in ("low", "high")))


def bonferroni_quantiles(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "id").agg(F.avg("score").alias("value"))
    out = paired.interval(s, comparisons=5, by=["method"])
    return paired.reverse_interval(out).select("method", r6("low").alias("low"), r6("high").alias("high"))


def auc_trapezoid(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "seed", "step").agg(F.avg("score").alias("score"))
    return metrics.auc(s, ["method", "seed"]).select("method", "seed", r6("auc").alias("auc"))


def _grid(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    return s.groupBy("method", "step").agg(F.round(F.avg("score"), 2).alias("score")).select("method", F.pow(F.lit(10.0), F.col("step") - 3).alias("epsilon"), F.col("step").alias("place"), "score")


def select_epsilon_min(spark, sf_dir):
    return metrics.pick_min(_grid(spark, sf_dir), ["method"], "score", "place", "epsilon")


def select_epsilon_max(spark, sf_dir):
    return metrics.pick_max(_grid(spark, sf_dir), ["method"], "score", "epsilon")


def pairing_problems(spark, sf_dir):
    s = c.scores(spark, sf_dir).select("method", "seed", "id", F.lit("g").alias("ground_truth")).distinct()
    expected = s.where("id % 3 <> 0").select("id", "ground_truth").distinct()
    return paired.pairing_problems(s.where("id % 10 <> 1"), expected, ["method", "seed"]).groupBy("method", "seed", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


def base_conflicts(spark, sf_dir):
    s = c.scores(spark, sf_dir).where("step = 1").groupBy("id", "seed").agg(r6(F.avg("score")).alias("score"))
    return paired.base_score_conflicts(s)


def _log(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    return s.groupBy("method", "seed", "step").agg(F.sum("response_tokens").alias("response_tokens"), F.sum("fit_seconds").alias("fit_seconds"), F.lit(64).alias("answers"))


def learning_curve_running(spark, sf_dir):
    out = runs.learning_curve(_log(spark, sf_dir), ["method", "seed"], [1, 3, 5])
    return out.select("method", "seed", "step", "answers", "total_response_tokens", r6("total_fit_seconds").alias("total_fit_seconds"))


def epoch_totals(spark, sf_dir):
    out = runs.running_totals(_log(spark, sf_dir), ["method", "seed"], ["response_tokens"], 3)
    return out.select("method", "seed", "step", "total_response_tokens")


def mean_curves(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "seed", "step").agg(F.avg("score").alias("score"))
    return runs.mean_curves(s, ["method"], ["score"]).select("method", "step", r6("score").alias("score"))


def best_epoch(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method", "seed", "step").agg(F.round(F.avg("score"), 3).alias("brier")).withColumnRenamed("step", "epoch")
    return runs.best_epoch(s, ["method", "seed"])


def budget_problems(spark, sf_dir):
    s = c.scores(spark, sf_dir).where("seed > 0 or step <> 3").groupBy("method", "seed", "step").agg(F.when(F.col("seed") == 1, 64).otherwise(60).alias("answers"))
    return runs.budget_problems(s)


def health_gates(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    a = s.groupBy("method", F.col("seed").alias("rank"), F.col("step").alias("update")).agg(
        F.avg("score").alias("mse_before"), (F.avg("score") - F.avg("fit_seconds") / 10).alias("mse_after"), F.avg("fit_seconds").alias("prediction_change"), F.lit(1.0).alias("grad_norm_max"),
        F.lit(0.1).alias("lr"), F.lit(0.0).alias("initial_value_abs_max"), F.max("fit_seconds").alias("audit_seconds"),
    )
    out = runs.audit_health(a, 7, 3, ["method"])
    return out.select("method", "passed", "complete", "targets_fit_better", r6("extra_seconds").alias("extra_seconds"), r6("mean_mse_before").alias("mean_mse_before"))


def select_profile(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy("method").agg(F.round(F.avg("score"), 1).alias("final"))
    out = runs.select_profile(s.select(F.col("method").alias("profile"), F.col("method").cast("int").alias("place"), (F.col("method") != "1").alias("passed"), F.lit(0.0).alias("initial"), "final"))
    return out.select("profile", "final")


def run_rotation(spark, sf_dir):
    s = c.scores(spark, sf_dir)
    return runs.run_order(s.select("seed", F.col("seed").alias("seed_pos")).distinct(), s.select(F.col("method").alias("arm"), (F.col("method").cast("int") - 1).alias("pos")).distinct())


def top_pilot(spark, sf_dir):
    s = c.scores(spark, sf_dir).groupBy(F.col("method").alias("kind"), F.col("step").alias("trial")).agg(F.round(F.avg("score"), 2).alias("brier"))
    return runs.top_pilot(s)


# --- ledgers -------------------------------------------------------------------------------------------------------


def allocations(spark, sf_dir):
    out = ledger.allocations(c.accounting(spark, sf_dir))
    return out.select("job_id_raw", "job_id", "gpus", r6("gpu_hours").alias("gpu_hours"), r6("cpu_hours").alias("cpu_hours"))


def ledger_totals(spark, sf_dir):
    owned = ledger.owned(ledger.check_ledger(c.ledger(spark, sf_dir)), ledger.allocations(c.accounting(spark, sf_dir)))
    return ledger.totals(owned).select("study", "stage", "allocations", r6("gpu_hours").alias("gpu_hours"), r6("cpu_hours").alias("cpu_hours"))


def missing_jobs(spark, sf_dir):
    return ledger.missing_jobs(c.ledger(spark, sf_dir), ledger.allocations(c.accounting(spark, sf_dir))).select("study", "stage", "job")


def zero_gpu_stages(spark, sf_dir):
    a = ledger.allocations(c.accounting(spark, sf_dir)).withColumn("gpu_hours", F.when(F.col("job_id").startswith("3"), F.col("gpu_hours")).otherwise(0.0))
    led = c.ledger(spark, sf_dir).withColumn("study", F.concat("study", F.substring("job", 1, 1)))
    return ledger.zero_gpu_warnings(ledger.owned(led, a)).select("study", "stage")


def stage_seconds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.select(F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("study"), F.concat(F.lit("fit-head-"), F.col("o_orderkey") % 7).alias("task"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("state"), F.floor("o_totalprice").cast("double").alias("seconds"))
    return ledger.stage_seconds(s)


def head_resources(spark, sf_dir):
    w = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50 + 769).cast("int").alias("slim"), (F.col("p_partkey") % 50 + 1537).cast("int").alias("wide")).distinct()
    return ledger.head_resources(w).select("slim", "wide", "slim_bytes", "wide_bytes", r6("storage_ratio").alias("storage_ratio"), r6("solve_ratio").alias("solve_ratio"))


def curve_join(spark, sf_dir):
    u = prefixes.subset_usage(prefixes.question_usage(c.answers(spark, sf_dir)), [1, 5], check=False)
    s = c.scores(spark, sf_dir).groupBy("method", "seed").agg(r6(F.avg("score")).alias("brier"))
    s = s.select(F.concat(F.lit("d"), F.col("seed") % 2, F.lit("/"), F.when(F.col("seed") < 2, 5).otherwise(1), F.lit("/arm"), "method").alias("key"), "brier")
    return ledger.curve_points(s, u).select("domain", "budget", "arm", "brier", "response_tokens")


def payload_checksum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"b": '), F.col("event_id"), F.lit(', "a": ['), F.col("user_id"), F.lit("]}"))
    right = F.concat(F.lit('{"a": ['), F.col("user_id"), F.lit('], "b": '), F.col("event_id"), F.lit("}"))
    rows = e.select("event_id", raw.alias("raw"), F.sha2(F.when(F.col("event_id") % 11 == 0, raw).otherwise(right), 256).alias("sha256"))
    return ledger.changed_payloads(rows).select("event_id")


SQL_HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"
SQL_GRID = f"{SQL_SCORES}, g AS (SELECT method, 10.0::DOUBLE ** (step - 3) AS epsilon, step AS place, round(avg(score), 2) AS score FROM s GROUP BY method, step)"
SQL_LOG = f"{SQL_SCORES}, l AS (SELECT method, seed, step, sum(response_tokens)::BIGINT AS response_tokens, sum(fit_seconds) AS fit_seconds, avg(score) AS score FROM s GROUP BY 1, 2, 3)"
SQL = {
    "gae_returns": f"""WITH RECURSIVE {SQL_EPISODES}, n AS (SELECT *, count(*) OVER (PARTITION BY answer) AS n, lead(value, 1, 0.0) OVER (PARTITION BY answer ORDER BY position) AS nv FROM e),
r AS (SELECT answer, position, reward + 0.9 * nv - value AS a FROM n WHERE position = n - 1
  UNION ALL SELECT n.answer, n.position, n.reward + 0.9 * n.nv - n.value + 0.9 * 0.8 * r.a FROM r JOIN n ON n.answer = r.answer AND n.position = r.position - 1)
SELECT answer, position, round(a, 6) AS advantage, round(a + value, 6) AS returns FROM r JOIN n USING (answer, position)""",
    "whitened_advantage": f"""WITH {SQL_EPISODES}, b AS (SELECT event_id, question % 3 AS batch, reward - value AS a FROM e)
SELECT event_id, batch, round((a - avg(a) OVER w) / sqrt(var_samp(a) OVER w + 1e-8), 6) AS whitened FROM b WINDOW w AS (PARTITION BY batch)""",
    "group_advantage": f"""WITH {SQL_EPISODES}, b AS (SELECT question, answer, max(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS reward FROM e GROUP BY 1, 2)
SELECT question, answer, reward, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6), 6) AS advantage FROM b WINDOW w AS (PARTITION BY question)""",
    "value_loss": f"""WITH {SQL_EPISODES}, b AS (SELECT question % 3 AS batch, answer, value AS v, value * 0.5 AS o, (question % 2)::DOUBLE AS r FROM e),
l AS (SELECT batch, answer, avg(0.5 * greatest((v - r) ** 2, (least(greatest(v, o - 0.2), o + 0.2) - r) ** 2)) AS l FROM b GROUP BY 1, 2)
SELECT batch, round(avg(l), 6) AS value_loss FROM l GROUP BY 1""",
    "policy_objective": f"""WITH {SQL_EPISODES}, b AS (SELECT question % 3 AS batch, value * 0.01 AS n, value * -0.2 AS o, reward - 0.3 AS a FROM e),
x AS (SELECT *, -exp(n - o) * a AS p, -least(greatest(exp(n - o), 0.8), 1.2) * a AS c FROM b)
SELECT batch, round(avg(greatest(p, c)), 6) AS objective, round(avg((c > p)::INT), 6) AS clip_share, round(avg(o - n), 6) AS kl FROM x GROUP BY 1""",
    "critic_diagnostics": f"""WITH {SQL_EPISODES}, b AS (SELECT question % 3 AS batch, answer, value * 0.1 AS b, value * 0.3 AS a, (question % 2)::DOUBLE AS r FROM e),
g AS (SELECT batch, answer, avg((b - r) ** 2) AS mb, avg((a - r) ** 2) AS ma FROM b GROUP BY 1, 2), h AS (SELECT batch, count(*) AS answers, avg(mb) AS mb, avg(ma) AS ma FROM g GROUP BY 1)
SELECT batch, any_value(answers) AS answers, round(any_value(mb), 6) AS mse_before, round(any_value(ma), 6) AS mse_after, round(avg(abs(a - b)), 6) AS prediction_change,
  round(max(abs(b)), 6) AS initial_value_abs_max, round(avg(r), 6) AS target_mean FROM b JOIN h USING (batch) GROUP BY 1""",
    "reward_contract": f"""WITH {SQL_EPISODES}, b AS (SELECT answer, position, CASE WHEN event_id % 89 = 0 THEN 0.5 ELSE reward END AS reward FROM e WHERE event_id % 97 <> 0),
g AS (SELECT answer, count(*) AS n, max(position) AS last, min(position) AS first, arg_max(reward, position) AS t, sum(abs(reward)) AS total FROM b GROUP BY 1),
p AS (SELECT 1 AS step, answer AS answer_id, CASE WHEN first <> 0 OR last + 1 <> n THEN 'positions' WHEN t NOT IN (0, 1) THEN 'terminal_reward' WHEN total <> t THEN 'early_reward' END AS problem FROM g)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "method_table": f"""WITH {SQL_SCORES}, a AS (SELECT method, seed, avg(score) AS a FROM s GROUP BY 1, 2)
SELECT method, count(*) AS seeds, round(avg(a), 6) AS accuracy, round(stddev_samp(a), 6) AS sd, round(100 * (avg(a) - (SELECT avg(score) FROM s WHERE step = 1)), 6) AS gain_pp FROM a GROUP BY 1""",
    "answer_summary": f"""WITH {SQL_SCORES} SELECT method, seed, count(DISTINCT id) AS questions, round(avg(score), 6) AS accuracy, round(avg(response_tokens), 6) AS mean_tokens, round(avg(capped::INT), 6) AS truncation_rate FROM s GROUP BY 1, 2""",
    "paired_differences": f"""WITH {SQL_SCORES}, a AS (SELECT seed, id, method, avg(score) AS a FROM s GROUP BY 1, 2, 3),
d AS (SELECT x.method || '-' || y.method AS pair, x.a - y.a AS d FROM a x JOIN a y ON x.seed = y.seed AND x.id = y.id AND x.method < y.method)
SELECT pair, count(*) AS n_rows, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM d GROUP BY 1""",
    "bootstrap_interval": f"""WITH {SQL_SCORES}, t AS (SELECT * FROM s WHERE method IN ('1', '2')), a AS (SELECT seed, id, method, avg(score) AS a FROM t GROUP BY 1, 2, 3),
d AS (SELECT x.seed, x.id, x.a - y.a AS d FROM a x JOIN a y ON x.seed = y.seed AND x.id = y.id AND x.method = '1' AND y.method = '2'),
w AS (SELECT id FROM d GROUP BY 1 HAVING count(*) = 3), r AS (SELECT d, dense_rank() OVER (ORDER BY seed) - 1 AS run, dense_rank() OVER (ORDER BY id) - 1 AS place FROM d WHERE id IN (SELECT id FROM w)),
ta AS (SELECT draw, {SQL_HASH.format("'2026:q:' || draw || ':' || slot")} % q AS place FROM (SELECT draw, unnest(range(q)) AS slot, q FROM range(1000) g(draw), (SELECT count(*) AS q FROM w))),
u AS (SELECT draw, run, sum(d) AS v, count(*) AS q FROM ta JOIN r USING (place) GROUP BY 1, 2),
m AS (SELECT draw, sum(v) / (3 * any_value(q)) AS v FROM u JOIN (SELECT draw, {SQL_HASH.format("'2026:s:' || draw || ':' || k")} % 3 AS run FROM range(1000) g(draw), range(3) h(k)) USING (draw, run) GROUP BY 1)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, (SELECT round(avg(d), 6) FROM r) AS mean FROM m""",
    "poisson_interval": f"""WITH {SQL_SCORES}, a AS (SELECT id, method, avg(score) AS a FROM s GROUP BY 1, 2),
d AS (SELECT x.id, x.a - y.a AS d FROM a x JOIN a y ON x.id = y.id AND x.method = '1' AND y.method = '2'),
w AS (SELECT draw, d, {SQL_HASH.format("'3:' || id || ':' || draw")} / 2.0::DOUBLE ** 52 AS u FROM d, range(500) g(draw)),
m AS (SELECT draw, sum(d * n) / sum(n) AS v FROM (SELECT draw, d, len(list_filter({paired.poisson_levels()}::DOUBLE[], lambda c: u >= c)) AS n FROM w) GROUP BY 1)
SELECT round(quantile_cont(v, 0.0125), 6) AS low, round(quantile_cont(v, 0.9875), 6) AS high FROM m""",
    "bonferroni_quantiles": f"""WITH {SQL_SCORES}, a AS (SELECT method, id, avg(score) AS a FROM s GROUP BY 1, 2)
SELECT method, round(-quantile_cont(a, 0.995), 6) AS low, round(-quantile_cont(a, 0.005), 6) AS high FROM a GROUP BY 1""",
    "auc_trapezoid": f"""WITH {SQL_LOG}, p AS (SELECT method, seed, step, (score + lag(score) OVER w) / 2 * (step - lag(step) OVER w) AS part FROM l WINDOW w AS (PARTITION BY method, seed ORDER BY step))
SELECT method, seed, round(sum(part) / (max(step) - min(step)), 6) AS auc FROM p GROUP BY 1, 2""",
    "select_epsilon_min": f"WITH {SQL_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, place) AS r FROM g) SELECT method, epsilon, score FROM r WHERE r = 1",
    "select_epsilon_max": f"""WITH {SQL_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, epsilon) AS r, max(epsilon) OVER (PARTITION BY method) AS top FROM g)
SELECT method, epsilon, score, epsilon = top AS at_ceiling FROM r WHERE r = 1""",
    "pairing_problems": f"""WITH {SQL_SCORES}, r AS (SELECT DISTINCT method, seed, id FROM s), h AS (SELECT * FROM r WHERE id % 10 <> 1), x AS (SELECT DISTINCT id FROM r WHERE id % 3 <> 0),
g AS (SELECT m.method, m.seed, x.id FROM (SELECT DISTINCT method, seed FROM h) m, x),
p AS (SELECT method, seed, id, 'missing' AS problem FROM g ANTI JOIN h USING (method, seed, id) UNION ALL SELECT method, seed, id, 'unexpected' FROM h ANTI JOIN g USING (method, seed, id))
SELECT method, seed, problem, count(*) AS n_rows FROM p GROUP BY 1, 2, 3""",
    "base_conflicts": f"""WITH {SQL_SCORES}, a AS (SELECT id, seed, round(avg(score), 6) AS score FROM s WHERE step = 1 GROUP BY 1, 2) SELECT id, min(score) AS low, max(score) AS high FROM a GROUP BY 1 HAVING min(score) <> max(score)""",
    "learning_curve_running": f"""WITH {SQL_LOG}, t AS (SELECT method, seed, step, step * 64 AS answers, sum(response_tokens) OVER w AS tr, sum(fit_seconds) OVER w AS tf FROM l WINDOW w AS (PARTITION BY method, seed ORDER BY step))
SELECT method, seed, step, answers, tr::BIGINT AS total_response_tokens, round(tf, 6) AS total_fit_seconds FROM t WHERE step IN (1, 3, 5)""",
    "epoch_totals": f"""WITH {SQL_LOG} SELECT method, seed, step, (sum(response_tokens) OVER (PARTITION BY method, seed, (step - 1) // 3 ORDER BY step))::BIGINT AS total_response_tokens FROM l""",
    "mean_curves": f"WITH {SQL_LOG} SELECT method, step, round(avg(score), 6) AS score FROM l GROUP BY 1, 2",
    "best_epoch": f"""WITH {SQL_LOG}, r AS (SELECT method, seed, step AS epoch, round(score, 3) AS brier, row_number() OVER (PARTITION BY method, seed ORDER BY round(score, 3), step) AS r FROM l)
SELECT method, seed, epoch, brier FROM r WHERE r = 1""",
    "budget_problems": f"""WITH {SQL_SCORES}, a AS (SELECT DISTINCT method, seed, step FROM s WHERE seed > 0 OR step <> 3), g AS (SELECT method, seed, count(*) AS n, min(step) AS lo, max(step) AS hi FROM a GROUP BY 1, 2),
p AS (SELECT method, seed, CASE WHEN lo <> 1 OR hi <> n THEN 'steps' WHEN seed <> 1 THEN 'answers' END AS problem FROM g)
SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT NULL, NULL, 'length' FROM g HAVING count(DISTINCT n) > 1""",
    "health_gates": f"""WITH {SQL_SCORES}, a AS (SELECT method, seed, step, avg(score) AS b, avg(score) - avg(fit_seconds) / 10 AS f, max(fit_seconds) AS s FROM s GROUP BY 1, 2, 3),
x AS (SELECT method, round(sum(s), 6) AS extra_seconds FROM (SELECT method, step, max(s) AS s FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT method, count(*) = 21 AND sum(f) < sum(b) AS passed, count(*) = 21 AS complete, sum(f) < sum(b) AS targets_fit_better, any_value(extra_seconds) AS extra_seconds, round(avg(b), 6) AS mean_mse_before FROM a JOIN x USING (method) GROUP BY 1""",
    "select_profile": f"WITH {SQL_SCORES}, a AS (SELECT method AS profile, round(avg(score), 1) AS final FROM s GROUP BY 1) SELECT * FROM a WHERE profile <> '1' ORDER BY final DESC, profile LIMIT 1",
    "run_rotation": f"WITH {SQL_SCORES} SELECT seed, arm, ((pos - seed + 5) % 5)::INTEGER AS place FROM (SELECT DISTINCT seed FROM s), (SELECT DISTINCT method AS arm, method::INTEGER - 1 AS pos FROM s)",
    "top_pilot": f"WITH {SQL_SCORES}, g AS (SELECT method AS kind, step AS trial, round(avg(score), 2) AS brier FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY brier, trial) AS r FROM g) SELECT kind, trial, brier FROM r WHERE r = 1",
    "allocations": f"WITH {SQL_ACCOUNTING} SELECT job_id_raw, job_id, gpus, round(gpu_hours, 6) AS gpu_hours, round(cpu_hours, 6) AS cpu_hours FROM al",
    "ledger_totals": f"""WITH {SQL_ACCOUNTING}, {SQL_LEDGER} SELECT study, stage, count(*) AS allocations, round(sum(gpu_hours), 6) AS gpu_hours, round(sum(cpu_hours), 6) AS cpu_hours
FROM al JOIN led USING (job) GROUP BY ROLLUP (study, stage)""",
    "missing_jobs": f"WITH {SQL_ACCOUNTING}, {SQL_LEDGER} SELECT study, stage, job FROM led WHERE job NOT IN (SELECT job FROM al)",
    "zero_gpu_stages": f"""WITH {SQL_ACCOUNTING}, {SQL_LEDGER}, o AS (SELECT study || substr(job, 1, 1) AS study, stage, CASE WHEN starts_with(job, '3') THEN gpu_hours ELSE 0 END AS g FROM al JOIN led USING (job))
SELECT study, stage FROM o WHERE stage IN ('generate', 'fit') GROUP BY 1, 2 HAVING sum(g) = 0""",
    "stage_seconds": "SELECT 's' || (o_orderkey % 3) AS study, 'fit-head' AS stage, sum(floor(o_totalprice)) AS seconds FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "head_resources": """WITH w AS (SELECT DISTINCT (p_partkey % 50 + 769)::INTEGER AS slim, (p_partkey % 50 + 1537)::INTEGER AS wide FROM part)
SELECT slim, wide, 8 * slim::BIGINT * slim AS slim_bytes, 8 * wide::BIGINT * wide AS wide_bytes, round((slim::DOUBLE ** 2) / wide::DOUBLE ** 2, 6) AS storage_ratio, round((slim::DOUBLE ** 3) / wide::DOUBLE ** 3, 6) AS solve_ratio FROM w""",
    "payload_checksum": "SELECT event_id FROM events WHERE event_id % 11 = 0",
}
SQL["curve_join"] = f"""WITH {SQL_SCORES}, {SQL_ANSWERS}, k AS (SELECT *, (verifier_status IN ('correct', 'incorrect') AND n_tokens > 0)::INT AS k FROM a),
u AS (SELECT domain, question_id, sum(n_tokens)::BIGINT AS response_tokens FROM k WHERE split = 'train' GROUP BY 1, 2 HAVING max(k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY question_id) AS r FROM u), b AS (SELECT domain, budget, sum(response_tokens)::BIGINT AS response_tokens FROM r JOIN (VALUES (1), (5)) b(budget) ON r <= budget GROUP BY 1, 2),
m AS (SELECT 'd' || (seed % 2) AS domain, CASE WHEN seed < 2 THEN 5 ELSE 1 END AS budget, 'arm' || method AS arm, round(avg(score), 6) AS brier FROM s GROUP BY method, seed)
SELECT domain, budget, arm, brier, response_tokens FROM m JOIN b USING (domain, budget)"""
QUERIES = {f.__name__: f for f in (
    gae_returns, whitened_advantage, group_advantage, value_loss, policy_objective, critic_diagnostics, reward_contract, method_table, answer_summary, paired_differences,
    bootstrap_interval, poisson_interval, bonferroni_quantiles, auc_trapezoid, select_epsilon_min, select_epsilon_max, pairing_problems, base_conflicts, learning_curve_running,
    epoch_totals, mean_curves, best_epoch, budget_problems, health_gates, select_profile, run_rotation, top_pilot, allocations, ledger_totals, missing_jobs, zero_gpu_stages,
    stage_seconds, head_resources, curve_join, payload_checksum,
)}

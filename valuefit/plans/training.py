"""Queries of vector features, statistics, heads, calibration and networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from valuefit.functions import vectors as v
from valuefit.operators import calibrate, heads, locks, metrics, neural, paired, stats, study
from valuefit.plans import flagship, solving
from valuefit.plans.concepts import SQL_PREFIXES, prefixes, r6
from valuefit.plans.solving import SQL_LINEAR
from valuefit.sources.scratch import shared_folder


def ridge_value_by_split(spark, sf_dir):
    return flagship.run(spark, sf_dir).select("split", "prefixes", "questions", *(r6(c).alias(c) for c in solving.METRICS))


def _coordinates(spark, sf_dir, x):
    p = prefixes(spark, sf_dir)
    return p.select("position", F.posexplode(x).alias("i", "c")).select("position", "i", r6("c").alias("c"))


def rms_normalize(spark, sf_dir):
    return _coordinates(spark, sf_dir, v.rms_coordinates(F.col("x")))


def layernorm(spark, sf_dir):
    return _coordinates(spark, sf_dir, v.layer_norm(F.col("x")))


def isotropic_stats(spark, sf_dir):
    mean, scale = stats.isotropic_normalization(prefixes(spark, sf_dir))
    row = F.array(*(F.lit(float(m)) for m in mean))
    return spark.range(1).select(r6(F.lit(scale)).alias("scale"), F.posexplode(row).alias("i", "mean")).select("scale", "i", r6("mean").alias("mean"))


def gram_entries(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    return stats.gram_entries(p).select("i", "j", r6("a").alias("a"))


def gram_partials(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    out = stats.add_partials(stats.ridge_partials(p, "split"))
    return out.select(F.col("key").alias("split"), F.col("n").cast("long").alias("n"), F.posexplode("v").alias("k", "v")).select("split", "n", "k", r6("v").alias("v"))


def lstd_entries(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    out = stats.add_partials(stats.lstd_partials(p, 0.5))
    return out.select(F.col("n").cast("long").alias("n"), F.col("answers").cast("long").alias("answers"), F.posexplode("v").alias("k", "v")).select("n", "answers", "k", r6("v").alias("v"))


def out_of_fold_predict(spark, sf_dir):
    p = prefixes(spark, sf_dir).withColumn("fold", (F.col("question").cast("int") % 2).cast("int"))
    return heads.out_of_fold(p, heads.fit_ridge(p, 0.01, "fold")).select("position", "fold", r6("value").alias("value"))


def ridge_grid_select(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    g = heads.ridge_grid(p.where("split = 'train'"), p.where("split = 'val'"))
    rows = F.array(*(F.struct(F.lit(float(e)).alias("epsilon"), F.lit(float(s)).alias("brier"), F.lit(e == g["best"]).alias("selected")) for e, s in g["scores"].items()))
    return spark.range(1).select(F.inline(rows)).withColumn("brier", r6("brier"))


def spectral_vs_direct(spark, sf_dir):
    """Values of the head of one penalty, from the eigendecomposition that serves all penalties."""
    p = prefixes(spark, sf_dir)
    s = stats.collect_statistics(stats.ridge_partials(p.where("split = 'train'")))[""]
    eig, u = np.linalg.eigh(s["a"])
    out = v.predict_many(p, np.array([u @ ((u.T @ s["b"]) / (eig + e)) for e in (1.0, 10.0)]))
    return out.select("position", r6(F.get("values", F.lit(0))).alias("value_1"), r6(F.get("values", F.lit(1))).alias("value_10"))


def budget_curves(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    study = heads.budget_study(p.where("split = 'train'"), p.where("split = 'val'"), [5, 15, 30])
    out = heads.evaluate_heads(p.where("split = 'test'"), study)
    return out.select("budget", "epsilon", "selected", *(r6(c).alias(c) for c in ("question_brier", "question_clipped_brier", "accuracy", "ece")))


def system_conditioning(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    s = stats.add_partials(stats.ridge_partials(p, "split"))
    systems = s.select(F.col("key").alias("run"), F.lit(0).alias("fold"), F.slice("v", 1, 65 * 65).alias("a"), F.slice("v", 65 * 65 + 1, 65).alias("b"))
    out = heads.conditioning(systems)
    return out.select("run", "epsilon", "rank", *(r6(F.log(c)).alias(f"log_{c}") for c in ("largest", "smallest", "condition", "norm")), r6("residual").alias("residual"))


def head_audit(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    s = stats.add_partials(stats.ridge_partials(p, "split"))
    w = heads.fit_ridge(p, 0.01, "split")
    wrong = {k: x + (0.1 if k == "val" else 0) for k, x in w.items()}
    stored = F.coalesce(*(F.when(F.col("key") == k, F.array(*(F.lit(float(y)) for y in x))) for k, x in wrong.items()))
    rows = s.select(F.col("key").alias("run"), F.lit(0).alias("fold"), F.slice("v", 1, 65 * 65).alias("a"), F.slice("v", 65 * 65 + 1, 65).alias("b"), stored.alias("w"), F.lit(0.01).alias("epsilon"))
    return heads.audit_heads(rows).select("run", "ok", r6("residual").alias("residual"))


def _linear(spark, sf_dir):
    """Predictions that need no fit: a fixed combination of all coordinates."""
    p = prefixes(spark, sf_dir)
    return p.select("question", "position", "split", "domain", "y", (v.vector_sum(F.col("x")) * 0.3 + 0.5).alias("value"))



def question_brier(spark, sf_dir):
    return metrics.question_brier(_linear(spark, sf_dir), ["split"]).select("split", r6("question_brier").alias("question_brier"))


def prefix_metrics(spark, sf_dir):
    m = metrics.prediction_metrics(_linear(spark, sf_dir), ["domain", "split"])
    return m.select("domain", "split", *(c if c in ("prefixes", "questions") else r6(c).alias(c) for c in m.columns if c not in ("domain", "split", "ece")))


def ece_10(spark, sf_dir):
    return metrics.calibration_error(_linear(spark, sf_dir), ["domain"]).select("domain", r6("ece").alias("ece"))


def constant_baseline(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    m = metrics.constant_baseline(p.where("split = 'train'"), p.where("split = 'test'"))
    return m.select("prefixes", "questions", *(r6(c).alias(c) for c in ("brier", "question_brier", "accuracy", "ece")))


def majority_accuracy(spark, sf_dir):
    return metrics.majority(prefixes(spark, sf_dir), ["split"]).select("split", r6("success_rate").alias("success_rate"), r6("majority_accuracy").alias("majority_accuracy"))


def calibrated_metrics(spark, sf_dir):
    rows = _linear(spark, sf_dir)
    m = calibrate.calibrated_metrics(rows.where("split = 'val'"), rows.where("split = 'test'"))
    return m.select("prefixes", *(F.round(c, 4).alias(c) for c in ("brier", "accuracy", "ece")))


def feature_pairing(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    other = p.where("position % 13 <> 0").withColumn("y", F.when(F.col("position") % 17 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return paired.feature_conflicts(p, other)


def combined_features(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    out = paired.combine_features(p.withColumn("x", v.layer_slice(F.col("x"), 0, 4)), p.withColumn("x", v.layer_slice(F.col("x"), 60, 4)))
    return out.select("position", F.size("x").alias("width"), r6(v.vector_sum(F.col("x"))).alias("total"))


def feature_guard(spark, sf_dir):
    p = prefixes(spark, sf_dir)
    x = F.when(F.col("position") % 10 == 0, F.concat(F.slice("x", 1, 63), F.array(F.lit(float("nan")))))
    x = x.when(F.col("position") % 10 == 1, F.slice("x", 1, 63)).otherwise(F.col("x"))
    return p.select("split", v.finite(x, 64).alias("ok")).groupBy("split", "ok").agg(F.count(F.lit(1)).alias("n_rows"))


def compressor_fit(spark, sf_dir):
    """Features of a fitted compressor, with the epoch and score that chose it; trained, so without SQL."""
    p = prefixes(spark, sf_dir)
    fit = neural.fit_compressor(p.where("split = 'train'"), p.where("split = 'val'"), 8)
    z = neural.transform(fit, p)
    return z.select("position", "split", F.lit(fit["epoch"]).alias("epoch"), r6(F.lit(fit["score"])).alias("score"), F.transform("x", lambda c: F.round(c, 4)).alias("features"))


def mlp_fit(spark, sf_dir):
    """Values of a fitted network, with the epoch and score that chose it; trained, so without SQL."""
    p = prefixes(spark, sf_dir)
    fit = neural.fit_mlp(p.where("split = 'train'"), p.where("split = 'val'"))
    q = fit["params"]
    out = v.batch_map(p, {"v": v.mlp_forward(q["w1"], q["b1"], q["w2"], float(q["b2"]))})
    return out.select("position", "split", F.lit(fit["epoch"]).alias("epoch"), r6(F.lit(fit["score"])).alias("score"), F.round(F.get("v", F.lit(0)), 4).alias("value"))


def joint_mlp_fit(spark, sf_dir):
    """Values of a network trained together with its compressor, with the epoch and score that chose it; trained, so without
    SQL."""
    p = prefixes(spark, sf_dir)
    train, val = p.where("split = 'train'"), p.where("split = 'val'")
    fit = neural.fit_joint(train, val, neural.fit_compressor(train, val, 8), steps=4)
    out = v.batch_map(p, {"v": lambda x: neural.joint_values(fit)(x)[:, None]})
    return out.select("position", "split", F.lit(fit["epoch"]).alias("epoch"), r6(F.lit(fit["score"])).alias("score"), F.round(F.get("v", F.lit(0)), 4).alias("value"))


def transfer_study(spark, sf_dir):
    """Seven arms of transfer from one domain to the other: penalty and score on validation, metrics on test; trained, so
    without SQL."""
    p = prefixes(spark, sf_dir)
    part = lambda d: {s: p.where((F.col("domain") == d) & (F.col("split") == s)) for s in ("train", "val")}
    arms = neural.transfer_arms(part("0"), part("1"), 8, 20, raw=lambda x: v.np_rms(x[:, 16:]))
    out = neural.evaluate_arms(p.where("domain = '1' and split = 'test'"), arms)
    info = F.array(*(F.struct(F.lit(k).alias("arm"), F.lit(a["width"]).alias("width"), F.lit(float(a["head"]["epsilon"])).alias("epsilon"), F.lit(a["head"]["score"]).alias("val_brier")) for k, a in arms.items()))
    known = spark.range(1).select(F.inline(info))
    return out.join(known, "arm").select("arm", "width", "epsilon", "prefixes", "questions", *(F.round(c, 4).alias(c) for c in ("val_brier", "question_brier", "question_clipped_brier", "accuracy", "ece")))


def representation_arms(spark, sf_dir):
    """Sums of the three representations of every vector, and of the last one centred and scaled by training statistics."""
    p = prefixes(spark, sf_dir)
    mean, scale = stats.isotropic_normalization(v.representation_arms(p.where("split = 'train'"), 16), "first")
    out = v.representation_arms(p, 16)
    centred = v.center_scale(F.col("first"), F.array(*(F.lit(float(m)) for m in mean)), F.lit(scale))
    squares = lambda c: r6(v.vector_sum(F.transform(c, lambda a: a * a * a)))
    return out.select(
        "position", *(F.size(k).alias(f"{k}_width") for k in v.representations(16)), *(squares(F.col(k)).alias(f"{k}_cubes") for k in v.representations(16)), squares(centred).alias("centred_cubes")
    )


STUDY = {"budgets": [4, 8, 14], "seeds": [42, 43]}


def layer_concat(spark, sf_dir):
    """The layers at distances 1, 2 and 4 from the end of eight, the last one first, as one vector."""
    p, chosen = prefixes(spark, sf_dir), v.select_layers(8, 2, 3)
    layers = p.select("position", *(v.layer_slice(F.col("x"), 8 * i, 8).alias(f"layer{i}") for i in range(8)))
    out = v.concat_layers(layers, [f"layer{i}" for i in chosen])
    return out.select("position", F.posexplode("x").alias("i", "c")).select("position", "i", r6("c").alias("c"))


def learning_study(spark, sf_dir):
    """Penalty, validation score and test metrics of heads for budgets x arms x domains x seeds."""
    p, arms = prefixes(spark, sf_dir), v.representations(16)
    found = study.arm_study(p.where("split = 'train'"), p.where("split = 'val'"), arms, **STUDY)
    out = study.evaluate_study(p.where("split = 'test'"), found, arms)
    return out.select("domain", "seed", "arm", "budget", "train_rows", "epsilon", r6("val_brier").alias("val_brier"), "prefixes", "questions", *(r6(c).alias(c) for c in ("question_brier", "question_clipped_brier", "accuracy")))


def locked_study(spark, sf_dir):
    """Selections and heads of all seeds are committed and checked before test rows are read; then they are evaluated."""
    p, arms, path = prefixes(spark, sf_dir), v.representations(16), shared_folder(spark, "locked")
    found = study.arm_study(p.where("split = 'train'"), p.where("split = 'val'"), arms, **STUDY)
    locks.lock(path, **study.study_tables(spark, found))
    tables, test = locks.after_lock(spark, path, lambda: prefixes(spark, sf_dir).where("split = 'test'"))
    out = study.evaluate_study(test, study.from_tables(tables), arms)
    return out.groupBy("domain", "arm", "budget").agg(
        F.count(F.lit(1)).alias("seeds"), r6(F.avg("val_brier")).alias("val_brier"), r6(F.avg("question_brier")).alias("question_brier"), r6(F.avg(F.log10("epsilon"))).alias("log_epsilon")
    )


SQL_ARMS = """ar AS (SELECT question, split, domain, y, 'rms_rest' AS arm, list_transform(x[17:64], lambda c: c / sqrt(list_inner_product(x[17:64], x[17:64]) / 48 + 1e-6::DOUBLE)) AS x, position FROM p
  UNION ALL SELECT question, split, domain, y, 'first_layernorm', list_transform(x[1:16], lambda c: (c - m) / sqrt(list_sum(list_transform(x[1:16], lambda d: (d - m) * (d - m))) / 16 + 1e-5::DOUBLE)), position
    FROM (SELECT *, list_sum(x[1:16]) / 16 AS m FROM p)
  UNION ALL SELECT question, split, domain, y, 'first', x[1:16], position FROM p)"""
SQL_EPSILONS = ", ".join(f"(1e{i}::DOUBLE)" for i in range(-2, 7))
SQL = solving.SQL | {
    "representation_arms": f"""WITH {SQL_PREFIXES}, {SQL_ARMS}, tr AS (SELECT x FROM ar WHERE arm = 'first' AND split = 'train'),
mo AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x[i]) AS m FROM tr, generate_series(1, 16) g(i) GROUP BY i)),
sc AS (SELECT any_value(mean) AS mean, sqrt(avg((x[i] - mean[i]) ** 2)) AS scale FROM tr, mo, generate_series(1, 16) g(i)),
cu AS (SELECT position, arm, len(x) AS width, round(list_sum(list_transform(x, lambda c: c ** 3)), 6) AS cubes FROM ar)
SELECT p.position, r.width::INTEGER AS rms_rest_width, l.width::INTEGER AS first_layernorm_width, f.width::INTEGER AS first_width, r.cubes AS rms_rest_cubes, l.cubes AS first_layernorm_cubes, f.cubes AS first_cubes,
  round(list_sum(list_transform(p.x[1:16], lambda c, i: ((c - mean[i]) / scale) ** 3)), 6) AS centred_cubes
FROM p JOIN cu r ON r.position = p.position AND r.arm = 'rms_rest' JOIN cu l ON l.position = p.position AND l.arm = 'first_layernorm' JOIN cu f ON f.position = p.position AND f.arm = 'first', sc""",
    # singular values of symmetric systems: the projection onto the largest comes from squaring the matrix 17 times, that onto
    # the smallest from squaring the inverse, which Gauss-Jordan elimination gives
    "system_conditioning": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT split || '/' || e AS key, x, y, e AS epsilon FROM p, (VALUES (0.0::DOUBLE), (0.01), (1.0)) t(e)), {solving.sql_systems("f")},
gj AS (SELECT key, 1 AS k, a AS m FROM sys UNION ALL
  SELECT key, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN v / m[k][k]
    WHEN j = k THEN -v / m[k][k] ELSE v - r[k] * m[k][j] / m[k][k] END)) FROM gj WHERE k <= 65),
iv AS (SELECT key, m AS inv FROM gj WHERE k = 66),
po AS (SELECT key || '>' AS key, a AS m, a AS b, 0 AS n FROM sys UNION ALL SELECT key || '<', inv, inv, 0 FROM iv),
sq AS (SELECT key, n, m, b FROM po UNION ALL SELECT key, n + 1, m, list_transform(c, lambda r: list_transform(r, lambda v: v / tr)) FROM (
  SELECT *, list_sum(list_transform(c, lambda r, i: r[i])) AS tr FROM (
    SELECT key, n, m, list_transform(b, lambda r: list_transform(b, lambda q: list_inner_product(r, q))) AS c FROM sq WHERE n < 17))),
ev AS (SELECT key, list_sum(list_transform(m, lambda r, i: list_inner_product(r, b[i]))) / list_sum(list_transform(b, lambda r, i: r[i])) AS v FROM sq WHERE n = 17),
la AS (SELECT key, max(v) FILTER (suffix(key, '>')) AS up, max(1 / v) FILTER (suffix(key, '<')) AS low FROM ev GROUP BY key),
bo AS (SELECT rtrim(key, '<>') AS key, max(up) AS largest, max(low) AS smallest FROM la GROUP BY rtrim(key, '<>')),
so AS (SELECT key, list_transform(inv, lambda r: list_inner_product(r, b)) AS w FROM iv JOIN sys USING (key))
SELECT split_part(key, '/', 1) AS run, split_part(key, '/', 2)::DOUBLE AS epsilon, CASE WHEN smallest > largest * 65 * 2.220446049250313e-16::DOUBLE THEN 65 END AS rank, round(ln(largest), 6) AS log_largest,
  round(ln(smallest), 6) AS log_smallest, round(ln(largest / smallest), 6) AS log_condition, round(ln(sqrt(list_inner_product(w, w))), 6) AS log_norm, 0.0::DOUBLE AS residual FROM bo JOIN so USING (key)""",
    "learning_study": f"""WITH RECURSIVE {SQL_PREFIXES}, {SQL_ARMS},
qs AS (SELECT *, row_number() OVER (PARTITION BY domain, seed ORDER BY sha256(seed || ':' || question), question) AS r
  FROM (SELECT DISTINCT domain, question FROM p WHERE split = 'train'), (VALUES {", ".join(f"({s})" for s in STUDY["seeds"])}) t(seed)),
f AS (SELECT domain || '/' || seed || '/' || arm || '/' || budget AS key, x, y FROM ar JOIN qs USING (domain, question) JOIN (VALUES {", ".join(f"({b})" for b in STUDY["budgets"])}) b(budget) ON r <= budget WHERE split = 'train'),
mo AS (SELECT key, i, avg(x[i]) AS m FROM (SELECT key, x, unnest(range(1, len(x) + 1)) AS i FROM f) GROUP BY key, i), ms AS (SELECT key, list(m ORDER BY i) AS mean FROM mo GROUP BY key),
ce AS (SELECT key, any_value(mean) AS mean, sqrt(avg((x[i] - mean[i]) ** 2)) AS scale, count(*) / any_value(len(x)) AS train_rows FROM (SELECT f.key, x, mean, unnest(range(1, len(x) + 1)) AS i FROM f JOIN ms USING (key)) GROUP BY key),
z AS (SELECT key, list_append(list_transform(x, lambda v, i: (v - mean[i]) / scale), 1.0) AS x, y FROM f JOIN ce USING (key)),
e0 AS (SELECT key, i, j, sum(x[i] * x[j]) AS v FROM (SELECT key, x, i, unnest(range(1, len(x) + 1)) AS j FROM (SELECT key, x, unnest(range(1, len(x) + 1)) AS i FROM z)) GROUP BY key, i, j),
e1 AS (SELECT key, i, list(v ORDER BY j) AS v FROM e0 GROUP BY key, i), e2 AS (SELECT key, list(v ORDER BY i) AS a FROM e1 GROUP BY key),
r1 AS (SELECT key, i, sum(x[i] * y) AS v FROM (SELECT key, x, y, unnest(range(1, len(x) + 1)) AS i FROM z) GROUP BY key, i), r2 AS (SELECT key, list(v ORDER BY i) AS b FROM r1 GROUP BY key),
sys AS (SELECT key || '/' || e AS key, list_transform(a, lambda row, i: list_transform(row, lambda v, j: v + CASE WHEN i = j THEN e ELSE 0 END)) AS a, b
  FROM e2 JOIN r2 USING (key), (VALUES {SQL_EPSILONS}) t(e)), {solving.SQL_SOLVE},
he AS (SELECT string_split(key, '/') AS k, w FROM sol),
hd AS (SELECT k[1] AS domain, k[2]::INTEGER AS seed, k[3] AS arm, k[4]::INTEGER AS budget, k[5]::DOUBLE AS epsilon, w, mean, scale, train_rows FROM he JOIN ce ON ce.key = array_to_string(k[1:4], '/')),
hp AS (SELECT domain, seed, arm, budget, epsilon, train_rows, split, question, y, list_inner_product(list_append(list_transform(x, lambda v, i: (v - mean[i]) / scale), 1.0), w) AS value FROM ar JOIN hd USING (domain, arm) WHERE split <> 'train'),
sb AS (SELECT domain, seed, arm, budget, epsilon, avg(e) AS score FROM (SELECT domain, seed, arm, budget, epsilon, question, avg((value - y) ** 2) AS e FROM hp WHERE split = 'val' GROUP BY ALL) GROUP BY ALL),
-- penalties beyond 1000 count only while all lower powers of ten were best in their turn
ok AS (SELECT *, min(score) OVER (PARTITION BY domain, seed, arm, budget ORDER BY epsilon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sb),
st AS (SELECT *, max(CASE WHEN epsilon >= 1000 AND score >= before THEN epsilon ELSE 0 END) OVER (PARTITION BY domain, seed, arm, budget ORDER BY epsilon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM ok),
sc AS (SELECT *, row_number() OVER (PARTITION BY domain, seed, arm, budget ORDER BY score, epsilon) AS r FROM st WHERE coalesce(stopped, 0) = 0),
l AS (SELECT domain || '/' || seed || '/' || arm || '/' || budget AS key, hp.* EXCLUDE (split), score FROM hp JOIN sc USING (domain, seed, arm, budget, epsilon) WHERE r = 1 AND split = 'test'),
me AS (SELECT key, any_value(domain) AS domain, any_value(seed) AS seed, any_value(arm) AS arm, any_value(budget) AS budget, any_value(epsilon) AS epsilon, any_value(train_rows) AS train_rows, any_value(score) AS score FROM l GROUP BY key),
{solving.sql_metrics("key", 'domain, seed, arm, budget, train_rows::BIGINT AS train_rows, epsilon, round(score, 6) AS val_brier, prefixes, questions, round(question_brier, 6) AS question_brier, round(question_clipped_brier, 6) AS question_clipped_brier, round(accuracy, 6) AS accuracy')} JOIN me USING (key)""",
}
SQL |= {
    "rms_normalize": f"""WITH {SQL_PREFIXES}, s AS (SELECT position, x, sqrt(list_inner_product(x, x) / 64 + 1e-6) AS s FROM p)
SELECT position, i::INTEGER AS i, round(x[i + 1] / s, 6) AS c FROM s, generate_series(0, 63) g(i)""",
    "layernorm": f"""WITH {SQL_PREFIXES}, m AS (SELECT position, x, list_sum(x) / 64 AS m FROM p),
s AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: (c - m) * (c - m))) / 64 + 1e-5) AS s FROM m)
SELECT position, i::INTEGER AS i, round((x[i + 1] - m) / s, 6) AS c FROM s, generate_series(0, 63) g(i)""",
    "isotropic_stats": f"""WITH {SQL_PREFIXES}, u AS (SELECT i, x[i + 1] AS c FROM p, generate_series(0, 63) g(i)), m AS (SELECT i, avg(c) AS mean FROM u GROUP BY 1)
SELECT (SELECT round(sqrt(avg((c - mean) * (c - mean))), 6) FROM u JOIN m USING (i)) AS scale, i::INTEGER AS i, round(mean, 6) AS mean FROM m""",
    "gram_entries": f"""WITH {SQL_PREFIXES}, r AS (SELECT list_append(x, 1.0) AS p, list_append(list_append(x, 1.0), y) AS q FROM p)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(p[i + 1] * q[j + 1]), 6) AS a FROM r, generate_series(0, 64) g(i), generate_series(0, 65) h(j) GROUP BY 1, 2""",
    "gram_partials": f"""WITH {SQL_PREFIXES}, r AS (SELECT split, list_append(x, 1.0) AS p, y FROM p)
SELECT split, count(*) AS n, (i * 65 + j)::INTEGER AS k, round(sum(p[i + 1] * p[j + 1]), 6) AS v FROM r, generate_series(0, 64) g(i), generate_series(0, 64) h(j) GROUP BY split, i, j
UNION ALL SELECT split, count(*), (4225 + i)::INTEGER, round(sum(p[i + 1] * y), 6) FROM r, generate_series(0, 64) g(i) GROUP BY split, i""",
    "lstd_entries": f"""WITH {SQL_PREFIXES}, r AS (SELECT question, response, y, row_number() OVER w - 1 AS k, list_append(x, 1.0) AS a, lead(list_append(x, 1.0)) OVER w AS n
  FROM p WINDOW w AS (PARTITION BY question, response ORDER BY position)),
e AS (SELECT question, response, k, i, y, n IS NULL AS last, a[i + 1] - coalesce(n[i + 1], 0) AS d,
  0.5 ** k * sum(a[i + 1] * 2.0 ** k) OVER (PARTITION BY question, response, i ORDER BY k) AS z FROM r, generate_series(0, 64) g(i)),
c AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM r WHERE n IS NULL) AS answers)
SELECT n, answers, (f.i * 65 + g.i)::INTEGER AS k, round(sum(f.z * g.d), 6) AS v FROM c, e f JOIN e g USING (question, response, k) GROUP BY n, answers, f.i, g.i
UNION ALL SELECT n, answers, (4225 + i)::INTEGER, round(coalesce(sum(z * y) FILTER (last), 0), 6) FROM c, e GROUP BY n, answers, i""",
    "question_brier": f"WITH {SQL_LINEAR} SELECT split, round(avg(e), 6) AS question_brier FROM (SELECT split, question, avg((value - y) ** 2) AS e FROM l GROUP BY 1, 2) GROUP BY 1",
    "prefix_metrics": f"""WITH {SQL_LINEAR}, k AS (SELECT domain, split, question, avg((value - y) ** 2) AS qe, avg((c - y) ** 2) AS qc FROM l GROUP BY 1, 2, 3),
g AS (SELECT domain, split, count(*) AS questions, round(avg(qe), 6) AS question_brier, round(avg(qc), 6) AS question_clipped_brier FROM k GROUP BY 1, 2)
SELECT domain, split, count(*) AS prefixes, any_value(questions) AS questions, round(avg((value - y) ** 2), 6) AS brier, round(avg((c - y) ** 2), 6) AS clipped_brier,
  round(avg(((value >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy, round(avg((value < 0 OR value > 1)::INT), 6) AS outside_unit, round(avg(y), 6) AS success_rate,
  any_value(question_brier) AS question_brier, any_value(question_clipped_brier) AS question_clipped_brier FROM l JOIN g USING (domain, split) GROUP BY 1, 2""",
    "ece_10": f"""WITH {SQL_LINEAR}, b AS (SELECT domain, CASE WHEN c >= 0.9::DOUBLE THEN 9 WHEN c >= 0.8::DOUBLE THEN 8 WHEN c >= 0.7::DOUBLE THEN 7 WHEN c >= 0.6::DOUBLE THEN 6 WHEN c >= 0.5::DOUBLE THEN 5
  WHEN c >= 0.4::DOUBLE THEN 4 WHEN c >= 0.3::DOUBLE THEN 3 WHEN c >= 0.2::DOUBLE THEN 2 WHEN c >= 0.1::DOUBLE THEN 1 ELSE 0 END AS bin, c, y FROM l),
g AS (SELECT domain, bin, count(*) AS n, abs(avg(c) - avg(y)) AS gap FROM b GROUP BY 1, 2) SELECT domain, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY 1""",
    "constant_baseline": f"""WITH {SQL_PREFIXES}, v AS (SELECT avg(y) AS v FROM p WHERE split = 'train'), t AS (SELECT question, y, v FROM p, v WHERE split = 'test'),
k AS (SELECT avg((v - y) ** 2) AS e FROM t GROUP BY question)
SELECT count(*) AS prefixes, count(DISTINCT question) AS questions, round(avg((v - y) ** 2), 6) AS brier, (SELECT round(avg(e), 6) FROM k) AS question_brier,
  round(avg(((v >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy, round(abs(any_value(v) - avg(y)), 6) AS ece FROM t""",
    "majority_accuracy": f"WITH {SQL_PREFIXES} SELECT split, round(avg(y), 6) AS success_rate, round(greatest(avg(y), 1 - avg(y)), 6) AS majority_accuracy FROM p GROUP BY 1",
    "feature_pairing": f"WITH {SQL_PREFIXES} SELECT question, response, position, CASE WHEN position % 13 = 0 THEN 'only_first' ELSE 'label' END AS problem FROM p WHERE position % 13 = 0 OR position % 17 = 0",
    "combined_features": f"WITH {SQL_PREFIXES} SELECT position, 8 AS width, round(list_sum(x[1:4]) + list_sum(x[61:64]), 6) AS total FROM p",
    "feature_guard": f"WITH {SQL_PREFIXES} SELECT split, position % 10 > 1 AS ok, count(*) AS n_rows FROM p GROUP BY 1, 2",
}
SQL["layer_concat"] = f"""WITH {SQL_PREFIXES}, c AS (SELECT position, list_concat(list_concat(x[57:64], x[49:56]), x[33:40]) AS x FROM p)
SELECT position, i::INTEGER AS i, round(x[i + 1], 6) AS c FROM c, generate_series(0, 23) g(i)"""
SQL["locked_study"] = f"""WITH st AS ({SQL["learning_study"]})
SELECT domain, arm, budget, count(*) AS seeds, round(avg(val_brier), 6) AS val_brier, round(avg(question_brier), 6) AS question_brier, round(avg(log10(epsilon)), 6) AS log_epsilon FROM st GROUP BY ALL""".replace(
    " round(score, 6) AS val_brier", " score AS val_brier").replace("round(question_brier, 6) AS question_brier, round(question_clipped_brier", "question_brier, round(question_clipped_brier")
QUERIES = {f.__name__: f for f in (
    ridge_value_by_split, rms_normalize, layernorm, isotropic_stats, gram_entries, gram_partials, lstd_entries, out_of_fold_predict, ridge_grid_select, spectral_vs_direct,
    budget_curves, system_conditioning, head_audit, question_brier, prefix_metrics, ece_10, constant_baseline, majority_accuracy, calibrated_metrics, feature_pairing,
    combined_features, feature_guard, compressor_fit, mlp_fit, joint_mlp_fit, transfer_study,
    representation_arms, learning_study, locked_study, layer_concat,
)}

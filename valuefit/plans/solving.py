"""SQL that fits what the training queries fit: linear systems by conjugate gradients, calibration by Newton's method."""

from __future__ import annotations

from valuefit.plans.concepts import SQL_PREFIXES

SQL_LINEAR = f"{SQL_PREFIXES}, l AS (SELECT question, position, split, domain, y, list_sum(x) * 0.3 + 0.5 AS value, greatest(0.0, least(1.0, list_sum(x) * 0.3 + 0.5)) AS c FROM p)"


def sql_systems(rows: str) -> str:
    """Systems ``sys`` (key, a, b) of the rows (key, x, y, epsilon) of a table: sums of products with a constant, and epsilon on the diagonal."""
    return f"""en AS (SELECT key, i, j, sum(c[i] * c[j]) + CASE WHEN i = j THEN any_value(epsilon) ELSE 0 END AS v
  FROM (SELECT key, epsilon, list_append(x, 1.0) AS c FROM {rows}), generate_series(1, 65) g(i), generate_series(1, 65) h(j) GROUP BY key, i, j),
ro AS (SELECT key, i, list(v ORDER BY j) AS v FROM en GROUP BY key, i), ma AS (SELECT key, list(v ORDER BY i) AS a FROM ro GROUP BY key),
ri AS (SELECT key, i, sum(c[i] * y) AS v FROM (SELECT key, y, list_append(x, 1.0) AS c FROM {rows}), generate_series(1, 65) g(i) GROUP BY key, i),
sys AS (SELECT key, any_value(a) AS a, list(v ORDER BY i) AS b FROM ma JOIN ri USING (key) GROUP BY key)"""


#: Weights ``sol`` (key, w) of the systems ``sys``; needs WITH RECURSIVE.
SQL_SOLVE = """cg AS (SELECT key, 0 AS n, list_transform(b, lambda v: 0.0::DOUBLE) AS w, b AS r, b AS d FROM sys
  UNION ALL SELECT key, n + 1, w, r, list_transform(r, lambda v, i: v + list_inner_product(r, r) / rr * d[i]) FROM (
    SELECT key, n, d, rr, list_transform(w, lambda v, i: v + step * d[i]) AS w, list_transform(r, lambda v, i: v - step * ad[i]) AS r FROM (
      SELECT *, rr / list_inner_product(d, ad) AS step FROM (
        SELECT key, n, w, r, d, list_inner_product(r, r) AS rr, list_transform(a, lambda v: list_inner_product(v, d)) AS ad
        FROM cg JOIN sys USING (key) WHERE n < 600 AND list_inner_product(r, r) > 1e-28::DOUBLE * list_inner_product(b, b))))),
sol AS (SELECT key, arg_max(w, n) AS w FROM cg GROUP BY key)"""


def sql_metrics(by: str, columns: str) -> str:
    """Metrics of ``l`` (by, question, value, y)."""
    return f"""v AS (SELECT *, greatest(0.0, least(1.0, value)) AS c FROM l),
bi AS (SELECT *, CASE WHEN c >= 0.9::DOUBLE THEN 9 WHEN c >= 0.8::DOUBLE THEN 8 WHEN c >= 0.7::DOUBLE THEN 7 WHEN c >= 0.6::DOUBLE THEN 6 WHEN c >= 0.5::DOUBLE THEN 5
  WHEN c >= 0.4::DOUBLE THEN 4 WHEN c >= 0.3::DOUBLE THEN 3 WHEN c >= 0.2::DOUBLE THEN 2 WHEN c >= 0.1::DOUBLE THEN 1 ELSE 0 END AS bin FROM v),
ga AS (SELECT {by}, sum(n * gap) / sum(n) AS ece FROM (SELECT {by}, bin, count(*) AS n, abs(avg(c) - avg(y)) AS gap FROM bi GROUP BY {by}, bin) GROUP BY {by}),
qu AS (SELECT {by}, count(*) AS questions, avg(e) AS question_brier, avg(f) AS question_clipped_brier
  FROM (SELECT {by}, question, avg((value - y) ** 2) AS e, avg((c - y) ** 2) AS f FROM v GROUP BY {by}, question) GROUP BY {by}),
pr AS (SELECT {by}, count(*) AS prefixes, avg((value - y) ** 2) AS brier, avg((c - y) ** 2) AS clipped_brier, avg(((value >= 0.5) = (y >= 0.5))::INT) AS accuracy,
  avg((value < 0 OR value > 1)::INT) AS outside_unit, avg(y) AS success_rate FROM v GROUP BY {by})
SELECT {columns} FROM pr JOIN qu USING ({by}) JOIN ga USING ({by})"""


METRICS = "brier clipped_brier accuracy outside_unit success_rate question_brier question_clipped_brier ece".split()
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
#: Rows ``z`` (key, x, y) centred and scaled, from ``f`` (key, x, y), with ``ce`` (key, mean, scale).
SQL_CENTRED = """mo AS (SELECT key, i, avg(x[i]) AS m FROM f, generate_series(1, 64) g(i) GROUP BY key, i), ms AS (SELECT key, list(m ORDER BY i) AS mean FROM mo GROUP BY key),
ce AS (SELECT key, any_value(mean) AS mean, sqrt(avg((x[i] - mean[i]) ** 2)) AS scale FROM f JOIN ms USING (key), generate_series(1, 64) g(i) GROUP BY key),
z AS (SELECT key || '/' || e AS key, list_transform(x, lambda v, i: (v - mean[i]) / scale) AS x, y, e AS epsilon
  FROM f JOIN ce USING (key), (VALUES (0.01::DOUBLE), (0.1), (1), (10), (100), (1000)) t(e))"""
#: Question-mean scores ``sc`` (key, epsilon, brier, selected) on validation rows; the six first penalties.
SQL_SCORED = """he AS (SELECT split_part(key, '/', 1) AS key, split_part(key, '/', 2)::DOUBLE AS epsilon, w FROM sol),
hp AS (SELECT key, epsilon, question, split, y, list_inner_product(list_append(list_transform(x, lambda v, i: (v - mean[i]) / scale), 1.0), w) AS value
  FROM p JOIN he ON split <> 'train' JOIN ce USING (key)),
sb AS (SELECT key, epsilon, avg(e) AS brier FROM (SELECT key, epsilon, question, avg((value - y) ** 2) AS e FROM hp WHERE split = 'val' GROUP BY 1, 2, 3) GROUP BY 1, 2),
sc AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY brier, epsilon) = 1 AS selected FROM sb)"""

SQL = {
    "ridge_value_by_split": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT '' AS key, x, y, 0.01::DOUBLE AS epsilon FROM p WHERE split = 'train'), {sql_systems("f")}, {SQL_SOLVE},
l AS (SELECT split, question, y, list_inner_product(list_append(x, 1.0), w) AS value FROM p, sol), {sql_metrics("split", f"split, prefixes, questions, {ROUNDED}")}""",
    "out_of_fold_predict": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT question::INTEGER % 2 AS key, position, x, y, 0.01::DOUBLE AS epsilon FROM p), {sql_systems("f")}, {SQL_SOLVE}
SELECT position, f.key AS fold, round(list_inner_product(list_append(x, 1.0), w), 6) AS value FROM f JOIN sol ON sol.key = 1 - f.key""",
    "ridge_grid_select": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT '' AS key, x, y FROM p WHERE split = 'train'), {SQL_CENTRED}, {sql_systems("z")}, {SQL_SOLVE}, {SQL_SCORED}
SELECT epsilon, round(brier, 6) AS brier, selected FROM sc""",
    "budget_curves": f"""WITH RECURSIVE {SQL_PREFIXES}, o AS (SELECT question, row_number() OVER (ORDER BY question) AS r FROM (SELECT DISTINCT question FROM p WHERE split = 'train')),
f AS (SELECT budget::VARCHAR AS key, x, y FROM p JOIN o USING (question) JOIN (VALUES (5), (15), (30)) t(budget) ON r <= budget WHERE split = 'train'),
{SQL_CENTRED}, {sql_systems("z")}, {SQL_SOLVE}, {SQL_SCORED},
l AS (SELECT key, epsilon, selected, question, value, y FROM hp JOIN sc USING (key, epsilon) WHERE split = 'test'),
{sql_metrics("key, epsilon, selected", "key::INTEGER AS budget, epsilon, selected, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("question_brier", "question_clipped_brier", "accuracy", "ece")))}""",
    "calibrated_metrics": f"""WITH RECURSIVE {SQL_LINEAR.replace("l AS", "li AS")}, va AS (SELECT value AS r, y AS t FROM li WHERE split = 'val'),
nt AS (SELECT 0 AS n, 1.0::DOUBLE AS s, 0.0::DOUBLE AS c UNION ALL
  SELECT n + 1, s - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), c - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT n, s, c, avg((q - t) * r) + 2e-5::DOUBLE * s AS g0, avg(q - t) + 2e-5::DOUBLE * c AS g1, avg(q * (1 - q) * r * r) + 2e-5::DOUBLE AS h0, avg(q * (1 - q) * r) AS h1, avg(q * (1 - q)) + 2e-5::DOUBLE AS h2
    FROM (SELECT n, s, c, r, t, 1 / (1 + exp(-(s * r + c))) AS q FROM nt, va WHERE n < 40) GROUP BY n, s, c)),
l AS (SELECT 0 AS one, question, y, 1 / (1 + exp(-(s * value + c))) AS value FROM (SELECT question, y, split, value FROM li), nt WHERE split = 'test' AND n = 40),
{sql_metrics("one", "prefixes, round(brier, 4) AS brier, round(accuracy, 4) AS accuracy, round(ece, 4) AS ece")}""",
    "spectral_vs_direct": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT epsilon::INTEGER AS key, x, y, epsilon FROM p, (VALUES (1.0::DOUBLE), (10.0)) t(epsilon) WHERE split = 'train'), {sql_systems("f")}, {SQL_SOLVE}
SELECT position, round(list_inner_product(list_append(x, 1.0), a.w), 6) AS value_1, round(list_inner_product(list_append(x, 1.0), b.w), 6) AS value_10 FROM p, sol a, sol b WHERE a.key = 1 AND b.key = 10""",
    "head_audit": f"""WITH RECURSIVE {SQL_PREFIXES}, f AS (SELECT split AS key, x, y, 0.01::DOUBLE AS epsilon FROM p), {sql_systems("f")}, {SQL_SOLVE},
st AS (SELECT key, a, b, list_transform(w, lambda v: v + CASE WHEN key = 'val' THEN 0.1 ELSE 0 END) AS w FROM sol JOIN sys USING (key)),
re AS (SELECT key, sqrt(list_sum(list_transform(list_transform(a, lambda v, i: list_inner_product(v, w) - b[i]), lambda v: v * v)))
  / (sqrt(list_sum(list_transform(a, lambda v: list_inner_product(v, v)))) * sqrt(list_inner_product(w, w)) + sqrt(list_inner_product(b, b))) AS residual FROM st)
SELECT key AS run, residual <= 1e-8 AS ok, round(residual, 6) AS residual FROM re""",
}

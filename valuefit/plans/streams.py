"""Queries of cumulative heads over streams of update batches, with SQL that solves every step's system."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuefit.plans import concepts as c
from valuefit.plans import solving
from valuefit.plans.concepts import SQL_EPISODES, r6
from valuefit.sources.scratch import shared_folder
from valuefit.streaming.cumulative import CumulativeHead, replay, write_steps

#: questions of an update, so that the number of updates grows with the table
PER_STEP = 50
METRICS = [m for m in solving.METRICS if m != "ece"]


def _updates(spark, sf_dir):
    """Update batches made of events: an answer's tokens with four features, its reward at the last."""
    place = F.col("position") / 10
    return c.episodes(spark, sf_dir).select(
        (F.floor(F.col("question") / PER_STEP) + 1).cast("int").alias("step"), F.col("answer").alias("answer_id"), F.col("question").cast("string").alias("question_id"),
        F.col("position").cast("int").alias("position"), F.array("value", F.col("value") * F.col("value"), place, F.col("value") * place).alias("x"), "reward",
    )


def _replayed(spark, u, again=None, **settings):
    """The head after a stream of all steps, each with the rows of ``again`` for it."""
    root, once = shared_folder(spark, "stream"), again is None
    if not once:  # else the rows are computed once, and the steps and folds need none of their windows
        u.persist()
    try:
        write_steps(u if once else u.unionByName(again), f"{root}/in")
        folds = None
        if settings.pop("folds", False):
            folds = u.select(F.col("question_id").alias("id"), (F.col("question_id").cast("int") % 2).cast("int").alias("fold")).distinct()
        head = CumulativeHead(spark, f"{root}/head", folds=folds, **settings)
        return head, replay(u, head, f"{root}/in", f"{root}/checkpoint")
    finally:
        if not once:
            u.unpersist()


def _log(out, *more):
    whole = lambda *names: (F.col(n).cast("int").alias(n) for n in names)
    return out.select("step", *whole("transitions", "answers"), "prefixes", "questions", *whole(*more), *(r6(m).alias(m) for m in (*METRICS, "residual")), F.round("effective", 9).alias("effective"))


def cumulative_stream_replay(spark, sf_dir):
    """Each update is added and then predicted: metrics, residual and effective penalty of every step."""
    return _log(_replayed(spark, _updates(spark, sf_dir), decay=0.9)[1])


def cumulative_stream_values(spark, sf_dir):
    """Out-of-fold values of every prefix, by two heads that leave each other's questions out."""
    head, _ = _replayed(spark, _updates(spark, sf_dir), decay=0.9, folds=True)
    return spark.read.parquet(f"{head.path}/values").select("step", "answer_id", "position", "fold", r6("value").alias("value"))


def cumulative_epochs_replay(spark, sf_dir):
    """Statistics start anew every two steps, and each update is predicted before it is added (0 by the first of an epoch)."""
    return _log(_replayed(spark, _updates(spark, sf_dir), decay=1.0, interval=2, order="predict_first")[1], "epoch")


def answer_resume_replay(spark, sf_dir):
    """Every update brings answers of the one before again: they get values, but are not added once more."""
    u = _updates(spark, sf_dir)
    last = u.agg(F.max("step")).first()[0]
    again = u.where((F.col("question_id").cast("int") % 5 == 0) & (F.col("step") < last)).withColumn("step", F.col("step") + 1)
    return _log(_replayed(spark, u, again, decay=0.9, by_answer=True)[1], "repeated")


def _sql(decay: float, columns: str = "", folds: bool = False, interval: int = 0, first: bool = False, again: bool = False, values: bool = False) -> str:
    epoch = f"(step - 1) // {interval}" if interval else "0"
    batch = "SELECT *, 0 AS again FROM t" + (" UNION ALL SELECT step + 1, * EXCLUDE (step), 1 FROM t WHERE question % 5 = 0 AND step < (SELECT max(step) FROM t)" if again else "")
    size = 5
    return f"""WITH RECURSIVE {SQL_EPISODES},
t AS (SELECT (question // {PER_STEP} + 1)::INTEGER AS step, question, answer, position, {"(question % 2)::INTEGER" if folds else "0"} AS fold,
  [value, value * value, position / 10, value * (position / 10), 1.0]::DOUBLE[] AS x, (question % 2)::DOUBLE AS y FROM e),
n AS (SELECT *, lead(x) OVER (PARTITION BY answer ORDER BY position) AS nx FROM t),
d AS (SELECT step, fold, answer, position, i, y, nx IS NULL AS last, x[i] - coalesce(nx[i], 0) AS d,
  {decay}::DOUBLE ** position * sum(x[i] * {decay}::DOUBLE ** -position) OVER (PARTITION BY answer, i ORDER BY position) AS z FROM n, generate_series(1, {size}) g(i)),
oa AS (SELECT f.step, f.fold, f.i, g.i AS j, sum(f.z * g.d) AS v FROM d f JOIN d g USING (answer, position) GROUP BY f.step, f.fold, f.i, g.i),
ob AS (SELECT step, fold, i, coalesce(sum(z * y) FILTER (last), 0) AS v FROM d GROUP BY step, fold, i),
sn AS (SELECT step, count(*) AS transitions, count(DISTINCT answer) AS answers FROM t GROUP BY step),
st AS (SELECT DISTINCT step, {epoch} AS epoch FROM t),
reach AS (SELECT a.step AS step, b.step AS own, a.epoch FROM st a JOIN st b ON b.step <= a.step AND a.epoch = b.epoch),
ma AS (SELECT p.step, fold, i, j, sum(v) + CASE WHEN i = j THEN 0.01::DOUBLE ELSE 0 END AS v FROM reach p JOIN oa ON oa.step = p.own GROUP BY p.step, fold, i, j),
mb AS (SELECT p.step, fold, i, sum(v) AS v FROM reach p JOIN ob ON ob.step = p.own GROUP BY p.step, fold, i),
na AS (SELECT step, fold, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM ma a JOIN ma b USING (step, fold, i) GROUP BY step, fold, a.j, b.j),
nb AS (SELECT step, fold, a.j AS i, sum(a.v * b.v) AS v FROM ma a JOIN mb b USING (step, fold, i) GROUP BY step, fold, a.j),
nr AS (SELECT step, fold, i, list(v ORDER BY j) AS v FROM na GROUP BY step, fold, i),
sys AS (SELECT step * 2 + fold AS key, list(r.v ORDER BY i) AS a, list(b.v ORDER BY i) AS b FROM nr r JOIN nb b USING (step, fold, i) GROUP BY step, fold),
{solving.SQL_SOLVE}, bt AS ({batch}),
l AS (SELECT bt.*, {"coalesce(list_inner_product(x, w), 0)" if first else "list_inner_product(x, w)"} AS value FROM bt JOIN st USING (step)
  LEFT JOIN sol ON key = {"CASE WHEN (step - 2) // " + str(interval) + " = epoch AND step > 1 THEN (step - 1) * 2 ELSE -1 END" if first else "step * 2 + " + ("1 - fold" if folds else "0")})""" + (
        ", v0 AS (SELECT * FROM l) SELECT step, answer AS answer_id, position::INTEGER AS position, fold, round(value, 6) AS value FROM v0" if values else f""",
nu AS (SELECT p.step, any_value(p.epoch)::INTEGER AS epoch, sum(transitions) AS transitions, sum(answers) AS answers FROM reach p JOIN sn ON sn.step = p.own GROUP BY p.step),
rp AS (SELECT step, count(DISTINCT answer) FILTER (again = 1) AS repeated FROM bt GROUP BY step),
{solving.sql_metrics("step", "step, transitions::INTEGER AS transitions, answers::INTEGER AS answers, prefixes, questions, " + columns + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + ", 0.0::DOUBLE AS residual, round(0.01::DOUBLE / transitions, 9) AS effective")}
  JOIN nu USING (step) JOIN rp USING (step)""")


SQL = {
    "cumulative_stream_replay": _sql(0.9),
    "cumulative_stream_values": _sql(0.9, folds=True, values=True),
    "cumulative_epochs_replay": _sql(1.0, "epoch, ", interval=2, first=True),
    "answer_resume_replay": _sql(0.9, "repeated::INTEGER AS repeated, ", again=True),
}
QUERIES = {f.__name__: f for f in (cumulative_stream_replay, cumulative_stream_values, cumulative_epochs_replay, answer_resume_replay)}

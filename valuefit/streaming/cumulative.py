"""A linear head that keeps only statistics over consecutive update batches.

State is one small row a fold, written as a new version; a ledger row a step commits it, so a failed batch leaves nothing
half-written and a replayed one changes nothing.  Steps that wait are added together: their statistics are summed by step in
one pass, running sums and heads follow from these on the driver, and all values come from a second pass, so that the number
of jobs grows with the groups of ``group`` steps and not with the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from valuefit.functions.vectors import predict
from valuefit.operators import heads, stats
from valuefit.operators.metrics import prediction_metrics
from valuefit.operators.prefixes import judged_answers
from valuefit.streaming.answers import AnswerLedger, answer_contents

LEDGER = "step int, epoch int, rows long, content string, runs array<string>"
STATE = "step int, epoch int, fold string, a array<double>, b array<double>, w array<double>, residual double, transitions long, answers long"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table that needs no job of its own."""
    kind = T._parse_datatype_string(schema)
    columns = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], c.type) for i, c in enumerate(columns)], schema=columns), kind)


@dataclass
class CumulativeHead:
    """T1 to T6.  ``decay`` 1 is ridge, less is LSTD; ``folds`` (question, fold) asks for out-of-fold values.

    Batches are long tables (step, answer_id, question_id, position, x, reward).  ``interval``: statistics start anew
    every so many steps (T3).  ``order``: predict after the batch is added, or before (T6).

    ``by_answer``: a ledger of all answers so far says which of a batch's answers are new.  Only those are added; answers
    that come again with the same rows get their values and count as ``repeated``, one that has changed is an error and
    leaves all as it was (T4).  The ledger starts anew with the statistics.

    ``group``: at most so many steps are added together; the driver holds their heads, and one running sum.
    """

    spark: SparkSession
    path: str
    decay: float = 1.0
    epsilon: float = 0.01
    interval: int | None = None
    folds: DataFrame | None = None
    order: str = "fit_first"
    keep: int = 3
    by_answer: bool = False
    group: int = 512
    state: dict[str, dict] = field(default_factory=dict)

    @property
    def answers(self) -> AnswerLedger:
        return AnswerLedger(self.spark, f"{self.path}/answers")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).json(f"{self.path}/ledger") if self._exists(f"{self.path}/ledger") else small_table(self.spark, [], LEDGER)

    def _committed(self, steps: list[int]) -> tuple[int, list[str], dict[int, tuple]]:
        """The last step of the ledger, its runs, and (rows, content) of those of ``steps`` that are there."""
        if not self._exists(f"{self.path}/ledger"):
            return 0, [], {}
        asked = F.when(F.col("step").between(min(steps), max(steps)), F.struct("step", "rows", "content"))  # a group of steps
        last, runs, known = self._ledger().agg(F.max("step"), F.max_by("runs", "step"), F.collect_list(asked)).first()
        return last or 0, list(runs or []), {r["step"]: (r["rows"], r["content"]) for r in known}

    @staticmethod
    def _dealt(batch: DataFrame) -> DataFrame:
        """The rows with their answer's outcome ``y``, which is the reward of its last row; an answer is in one partition."""
        return batch.withColumn("y", F.max_by("reward", "position").over(W.partitionBy("step", "answer_id")).cast("double"))

    @staticmethod
    def _contents(dealt: DataFrame) -> dict[int, tuple]:
        """{step: rows, a hash of them that does not depend on their order or partitions, least and largest width, answers that
        break the contract}."""
        row, size = F.xxhash64("answer_id", "question_id", "position", "x", F.col("reward").cast("double")), F.size("x")
        each = judged_answers(dealt, F.sum(row.cast("decimal(38,0)")).alias("hash"), F.min(size).alias("least"), F.max(size).alias("most"))
        found = each.groupBy("step").agg(F.sum("n"), F.sum("hash"), F.min("least"), F.max("most"), F.count("problem")).collect()
        return {r[0]: (r[1], str(r[2] or 0), r[3], r[4], r[5]) for r in found}

    def last_step(self) -> int:
        return self._ledger().agg(F.max("step")).first()[0] or 0

    def load(self, step: int) -> dict[str, dict]:
        """T4: the statistics of a committed step."""
        if step == 0:
            return {}
        out = {}
        for r in self.spark.read.schema(STATE).parquet(f"{self.path}/state/step={step}").drop("step").collect():
            k = len(r["b"])
            out[r["fold"]] = {"a": np.array(r["a"]).reshape(k, k), "b": np.array(r["b"]), "w": np.array(r["w"]), "n": r["transitions"], "answers": r["answers"], "epoch": r["epoch"]}
        return out

    def epoch(self, step: int) -> int:
        return (step - 1) // self.interval if self.interval else 0

    def _rows(self, dealt: DataFrame) -> DataFrame:
        """step, x, y (the answer's outcome), position, answer and fold."""
        kept = ["fresh"] if "fresh" in dealt.columns else []
        rows = dealt.where("answer_id is not null").select("step", "answer_id", F.col("question_id").alias("question"), "position", "x", "y", *kept)
        if self.folds is None:
            return rows.withColumn("fold", F.lit(0))
        return rows.join(self.folds.select(F.col("id").alias("question"), "fold"), "question")

    def _statistics(self, rows: DataFrame, n: int) -> Iterator[tuple[int, dict[str, dict]]]:
        """Each step's own statistics by fold, in the order of the steps; steps without rows are left out."""
        fold = F.lit("") if self.folds is None else F.col("fold").cast("string")
        lots = max(8, min(256, n // 50_000))
        keyed = rows.withColumn("_key", F.concat_ws(":", F.format_string("%012d", "step"), fold))
        dealt = self.folds is None and not self.by_answer  # what is joined may be dealt in another way
        partials = stats.lstd_partials(keyed, self.decay, "_key", ["step", "question", "answer_id"], lots, dealt)
        found = stats.add_partials(partials, lots=keyed.rdd.getNumPartitions() if dealt else lots).orderBy("key")
        for step, some in groupby(stats.each_statistics(found), lambda kv: int(kv[0].split(":")[0])):
            yield step, {k.split(":")[1]: s for k, s in some}

    def _added(self, now: dict, new: dict[str, dict]) -> dict:
        """The statistics with those of new rows, and the heads that they give."""
        out = dict(now)
        for k, s in new.items():
            if k in out and len(out[k]["b"]) != len(s["b"]):
                raise ValueError("the features' width changed without a new epoch")
            old = out.get(k, {"a": 0, "b": 0, "n": 0, "answers": 0})
            out[k] = {"a": old["a"] + s["a"], "b": old["b"] + s["b"], "n": old["n"] + s["n"], "answers": old["answers"] + s["answers"]}
        for k, s in out.items():
            out[k] = {**s, "w": heads.fit_system(s["a"], s["b"], self.epsilon)}
            out[k]["residual"] = heads.relative_residual(s["a"] + self.epsilon * np.eye(len(s["b"])), out[k]["w"], s["b"])
        return out

    def _values(self, rows: DataFrame, weights: dict[int, dict[str, list[float]]]) -> DataFrame:
        """``value`` by the heads of each step: 0 where a step has none, null where only the fold's is not there."""
        table = small_table(self.spark, list(weights.items()), "step int, _heads map<string, array<double>>")
        key = F.lit("") if self.folds is None else (1 - F.col("fold")).cast("string")
        value = F.when(F.size("_heads") == 0, F.lit(0.0)).otherwise(predict(F.col("x"), F.col("_heads")[key]))
        return rows.join(F.broadcast(table), "step").withColumn("value", value).drop("_heads")

    def update(self, batch: DataFrame, step: int, feature_epoch: int | None = None) -> DataFrame | None:
        """Add one batch, a whole step, and give its values; None if the step was committed before with the same rows.

        Other rows for a committed step are an error: part of a step never counts as the step.
        """
        return self.update_many(batch.withColumn("step", F.lit(step)), [step], feature_epoch)

    def update_many(self, batch: DataFrame, steps: list[int], feature_epoch: int | None = None, values: bool = True) -> DataFrame | None:
        """Add whole steps, as if one came after the other, and give the values of those that were not there before.

        If a step is not as it should be, those before it are added and then it is an error.  The rows are read and dealt by
        answer once.  Without ``values`` nothing is given.
        """
        last, runs, known = self._committed(steps)
        dealt = self._dealt(batch.where(F.col("step").between(min(steps), max(steps)))).persist()
        try:
            contents, todo, problem, saved, schema = self._contents(dealt), [], None, [], None
            for step in sorted(set(steps)):
                rows, content, least, most, broken = contents.get(step, (0, "0", None, None, 0))
                if step in known:
                    problem = None if known[step] == (rows, content) else f"step {step} was committed with other rows"
                elif step != (before := todo[-1] if todo else last) + 1:
                    problem = f"steps have to be consecutive: {step} after {before}"
                elif feature_epoch is not None and feature_epoch != self.epoch(step):
                    problem = f"features of epoch {feature_epoch}, statistics of {self.epoch(step)}"
                elif least != most:
                    problem = f"step {step} has features of different widths"
                elif broken:
                    problem = "an answer's rewards or positions break the contract"
                else:
                    todo.append(step)
                if problem:
                    break
            # features of another width, which come with a new epoch, never meet in one pass
            width = None
            widths = [(s, width := contents[s][2] if s in contents else width) for s in todo]
            for _, same in groupby(widths, lambda sw: sw[1]):
                done, runs, schema = self._add([s for s, _ in same], dealt, contents, last, runs)
                last, saved = done[-1], saved + [s for s in done if s in contents]
        finally:
            dealt.unpersist()
        if problem:
            raise ValueError(problem)
        if not todo or not values:
            return None
        if not saved:
            return small_table(self.spark, [], schema.simpleString())
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/values").parquet(*(f"{self.path}/values/step={s}" for s in saved))

    def _add(self, steps: list[int], dealt: DataFrame, contents: dict[int, tuple], last: int, runs: list[str]) -> tuple[list[int], list[str], T.StructType]:
        """Add steps whose features have one width, after the ``last`` one, and give them, the runs that count now, and the
        schema of their values; of steps that cannot be added the first is an error."""
        now = self.load(last)
        if last and any(e != self.epoch(steps[0]) for e in [self.epoch(last), *(s["epoch"] for s in now.values())]):
            now, runs = {}, []
        batch, judged, repeated, error = dealt.where(F.col("step").between(steps[0], steps[-1])), None, {}, None
        try:
            if self.by_answer:
                judged, repeated, bad = self._judged(batch, runs, self.epoch(steps[0]))
                if bad is not None:
                    some = [r["key"] for r in judged.where((F.col("state") == "changed") & (F.col("step") == bad)).orderBy("key").limit(5).collect()]
                    error = ValueError(f"{repeated[bad, 'changed']} answers have changed since they were added: {', '.join(some)}")
                    steps = [s for s in steps if s < bad]
                    if not steps:
                        raise error
                    batch = batch.where(F.col("step") < bad)
                batch = batch.join(judged.select("step", F.col("key").alias("answer_id"), (F.col("state") == "new").alias("fresh")), ["step", "answer_id"])
            rows = self._rows(batch)
            if self.by_answer or self.folds is not None:
                rows.persist()
            try:
                done, runs, schema, failed = self._commit(rows, now, steps, contents, judged, repeated, runs)
            finally:
                if self.by_answer or self.folds is not None:
                    rows.unpersist()
        finally:
            if judged is not None:
                judged.unpersist()
        if failed or error:
            raise failed or error
        return done, runs, schema

    def _judged(self, batch: DataFrame, runs: list[str], epoch: int) -> tuple[DataFrame, dict, int | None]:
        """The batch's answers (step, key, content) as the ledger, of ``epoch``, and the steps before judge them, how many of a
        state a step has, and the first step with changed ones."""
        at = F.floor((F.col("step") - 1) / self.interval) if self.interval else F.lit(0)
        contents = answer_contents(batch, "step").withColumn("epoch", at.cast("int")).persist()
        try:
            judged = self.answers.judged(contents, runs, contents.count(), epoch).persist()
            counts = {(r["step"], r["state"]): r["count"] for r in judged.groupBy("step", "state").count().collect()}
        finally:
            contents.unpersist()
        return judged, counts, min((s for s, state in counts if state == "changed"), default=None)

    def _commit(self, rows: DataFrame, now: dict, steps: list[int], contents: dict, judged: DataFrame | None, repeated: dict, runs: list[str]) -> tuple[list[int], list[str], T.StructType, ValueError | None]:
        """Values, states, metrics and ledger rows of the steps up to the first that cannot be solved, and its error."""
        own = self._statistics(rows if judged is None else rows.where("fresh"), sum(contents[s][0] for s in steps if s in contents))
        nothing: tuple = (None, {})
        ahead = next(own, nothing)
        log, weights, states, failed, done = [], {}, {}, None, []
        for step in steps:
            epoch = self.epoch(step)
            if step > steps[0] and epoch != self.epoch(step - 1):
                now, runs = {}, []
            new = {}
            if ahead[0] == step:
                new, ahead = ahead[1], next(own, nothing)
            try:
                after = self._added(now, new)
            except ValueError as e:
                failed = e
                break
            weights[step] = {k: s["w"].tolist() for k, s in (now if self.order == "predict_first" else after).items()}
            transitions = int(sum(s["n"] for s in after.values()))
            log.append((step, epoch, transitions, int(sum(s["answers"] for s in after.values())), repeated.get((step, "repeated"), 0),
                        float(max((s["residual"] for s in after.values()), default=0.0)), self.epsilon / max(1, transitions)))
            states[step], now = after, after
            states.pop(step - self.keep, None)
            done.append(step)
        if not done:
            raise failed
        last = done[-1]
        rows = rows.where(F.col("step") <= last)
        state = [(step, self.epoch(step), k, s["a"].ravel().tolist(), s["b"].tolist(), s["w"].tolist(), s["residual"], int(s["n"]), int(s["answers"]))
                 for step, after in states.items() for k, s in after.items()]
        self._overwrite(small_table(self.spark, state, STATE).coalesce(1), "state")
        kept, replaced = runs, []
        if judged is not None:
            mine = judged.where((F.col("state") == "new") & (F.col("step") <= last) & (F.col("epoch") == self.epoch(last)))
            kept, replaced = self.answers.add(mine, runs, last)
        values = self._values(rows, weights)
        self._overwrite(values.hint("rebalance", "step"), "values")
        # T5: one row of metrics a step
        about = small_table(self.spark, log, "step int, epoch int, transitions long, answers long, repeated long, residual double, effective double")
        found = about.join(prediction_metrics(values.where("value is not null"), ["step"]), "step", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
        self._overwrite(found.repartition(min(8, len(done)), "step"), "metrics")
        # steps are there once their ledger rows are
        rows_of = [(s, self.epoch(s), *contents.get(s, (0, "0"))[:2], kept if s == last else []) for s in done]
        small_table(self.spark, rows_of, LEDGER).coalesce(1).write.mode("append").json(f"{self.path}/ledger")
        self.answers.drop(replaced)
        for step in range(max(1, done[0] - self.keep), last - self.keep + 1):
            self._forget(step)
        return done, kept, values.schema, failed

    def _overwrite(self, df: DataFrame, name: str) -> None:
        """The steps of ``df``, each a folder; others stay as they are."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(f"{self.path}/{name}")

    def _forget(self, step: int) -> None:
        if step > 0:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/step={step}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def foreach_step(self, steps: DataFrame, source: str, schema: T.StructType) -> None:
        """For ``writeStream.foreachBatch`` over the marks of complete steps: the rows of up to ``group`` steps are read and added
        together, each step whole."""
        some: list[int] = []
        for row in steps.select("step").distinct().orderBy("step").toLocalIterator():
            some.append(row["step"])
            if len(some) == self.group:
                self._foreach(some, source, schema)
                some = []
        if some:
            self._foreach(some, source, schema)

    def _foreach(self, steps: list[int], source: str, schema: T.StructType) -> None:
        paths = [f"{source}/steps/step={s}" for s in steps]
        self.update_many(self.spark.read.schema(T.StructType([*schema.fields, T.StructField("step", T.IntegerType())])).option("basePath", f"{source}/steps").parquet(*paths), steps, None, False)


def write_step(batch: DataFrame, source: str, step: int) -> None:
    """A step's rows, by as many tasks as they have partitions, and then the mark that they are complete."""
    batch.drop("step").write.mode("overwrite").parquet(f"{source}/steps/step={step}")
    batch.sparkSession.createDataFrame([(step,)], "step int").coalesce(1).write.mode("append").json(f"{source}/marks")


def write_steps(batches: DataFrame, source: str) -> None:
    """Many steps' rows in one pass, each step by as many tasks as its size asks for, and then their marks."""
    batches.hint("rebalance", "step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(f"{source}/steps")
    batches.select("step").distinct().coalesce(1).write.mode("append").json(f"{source}/marks")


def replay(updates: DataFrame, head: CumulativeHead, source: str, checkpoint: str) -> DataFrame:
    """Run steps that ``write_step`` or ``write_steps`` has written through a stream of their marks, and give all steps' metrics."""
    schema = updates.drop("step").schema
    stream = head.spark.readStream.schema("step int").json(f"{source}/marks")
    query = stream.writeStream.foreachBatch(lambda marks, _: head.foreach_step(marks, source, schema))
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return head.spark.read.parquet(f"{head.path}/metrics")

"""A ledger of answers already counted, kept in hash buckets and compacted by levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RUN = "key string, content string, bucket int"


def answer_contents(batch: DataFrame, *by: str) -> DataFrame:
    """(by, key, content) of each answer of long rows: a hash of its rows that does not depend on their order."""
    row = F.xxhash64("answer_id", "question_id", "position", "x", F.col("reward").cast("double"))
    return batch.groupBy(*by, F.col("answer_id").cast("string").alias("key")).agg(
        F.concat_ws("/", F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row, "x"))).alias("content")
    )


@dataclass
class AnswerLedger:
    """T4: which answers are in the statistics, with a hash of their content.

    Each batch adds a run: files by hash bucket, sorted by key.  ``fan`` runs of a level become one of the next, so a key is
    rewritten once a level and a batch meets few runs.  Which runs count is up to the caller, who commits their names
    together with what was made of the answers; a run that was never committed is written over.

    A batch is joined to the runs by bucket and key: while it has at most ``broadcast_rows`` answers it goes to the tasks
    that read the runs, of which only its buckets are read; beyond that both sides are shuffled.
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    fan: int = 4
    broadcast_rows: int = 1_000_000

    def _bucketed(self, answers: DataFrame) -> DataFrame:
        return answers.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _read(self, runs: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for run in runs:  # a few a level
            out = out.unionByName(self.spark.read.schema(RUN).parquet(f"{self.path}/{run}"))
        return out

    def judged(self, answers: DataFrame, runs: list[str], rows: int, epoch: int = 0) -> DataFrame:
        """``answers`` (step, epoch, key, content) with ``state``: new, repeated (same content) or changed.

        What a key is compared with is in the runs, which are of ``epoch``, or else the first of its epoch's steps here.
        """
        mine = self._bucketed(answers)
        side = F.broadcast(mine) if rows <= self.broadcast_rows else mine
        known = self._read(runs).withColumnRenamed("content", "old").join(side.select("bucket", "key"), ["bucket", "key"], "left_semi")
        first = F.first(F.struct("step", "content")).over(W.partitionBy("epoch", "key").orderBy("step"))  # a row a step
        both = mine.join(known, ["bucket", "key"], "left").withColumns({"first": first, "old": F.when(F.col("epoch") == epoch, F.col("old"))})
        new = F.col("old").isNull() & (F.col("step") == F.col("first.step"))
        state = F.when(new, "new").when(F.coalesce("old", "first.content") == F.col("content"), "repeated").otherwise("changed")
        return both.select("step", "epoch", "key", "content", state.alias("state"))

    def add(self, answers: DataFrame, runs: list[str], step: int) -> tuple[list[str], list[str]]:
        """Write ``answers`` as a run and merge levels that are full: the names of the runs that count from now on, and of
        those that can go once this is committed."""
        replaced, runs = [], [*runs, self._write(self._bucketed(answers.select("key", "content")), f"level0-{step}")]
        level = 0
        while len(full := [r for r in runs if r.startswith(f"level{level}-")]) >= self.fan:
            merged = self._write(self._read(full), f"level{level + 1}-{step}")
            runs, replaced = [r for r in runs if r not in full] + [merged], replaced + full
            level += 1
        return runs, replaced

    def _write(self, answers: DataFrame, name: str) -> str:
        dealt = answers.repartition("bucket").sortWithinPartitions("bucket", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def drop(self, runs: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for run in runs:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

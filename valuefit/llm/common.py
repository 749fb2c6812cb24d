"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` is the quick way where a text has only ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_hashes(*columns: str) -> list[Column]:
    """128 bits of a row's values, as two longs.  A hash passes over nulls, so whether a value is null is hashed too."""
    flagged = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*flagged), F.xxhash64(F.lit(7), *reversed(flagged))]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary
    folder, and any other an error, since executors could not read what others write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="valuefit-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spare(frame: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``frame`` has columns called so (Spark does not tell cases apart)."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts the lineage: a lost executor costs no recomputation of what came before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing needs any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(frame: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast a side whose counted rows fit the bound; else leave the join to Spark's shuffle joins."""
    return F.broadcast(frame) if rows <= most else frame

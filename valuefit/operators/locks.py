"""Selections that are settled before any test row is read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content(df: DataFrame) -> str:
    """Rows and a digest of them that does not depend on their order or partitions; columns count by name."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("d"))
    quarter = lambda i: F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")
    found = rows.agg(F.count(F.lit(1)), *(F.sum(quarter(i)) for i in range(4))).first()
    return "-".join(str(int(v or 0)) for v in found)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def lock(path: str, **tables: DataFrame) -> dict[str, str]:
    """Save tables (the selection of all seeds, the fitted heads, ...) and commit them, once.

    The commit is one file with the digest of every table, made only if it is not there: of two that try, one fails, and a
    try that ended before its commit may be made again.  Nothing that is committed is ever written over.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, mark = _file(spark, f"{path}/locked.json")
    if fs.exists(mark):
        raise ValueError(f"{path} is locked already")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    digests = {name: content(spark.read.parquet(f"{path}/{name}")) for name in tables}
    out = fs.create(mark, False)  # an error where the file has come to be meanwhile
    try:
        out.write(bytearray(json.dumps(digests, sort_keys=True).encode()))
    finally:
        out.close()
    return digests


def locked(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a commit, after their digests have been compared; no commit or other rows are an error."""
    fs, mark = _file(spark, f"{path}/locked.json")
    if not fs.exists(mark):
        raise ValueError(f"{path} is not locked: no test row may be read yet")
    digests = json.loads(spark.read.text(f"{path}/locked.json").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in digests}
    changed = [name for name, df in tables.items() if content(df) != digests[name]]
    if changed:
        raise ValueError(f"changed since they were locked: {', '.join(changed)}")
    return tables


def after_lock(spark: SparkSession, path: str, read) -> tuple[dict[str, DataFrame], DataFrame]:
    """The committed tables and the test rows that ``read()`` gives, which is called only once the commit has been checked."""
    tables = locked(spark, path)
    return tables, read()

"""The folder for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; any other session gets an error, since its executors
    would not see what others write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="valuefit-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"

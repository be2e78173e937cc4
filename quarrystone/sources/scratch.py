"""A folder for intermediate results that every executor reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; below the session's warehouse only on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set, and executors may not share another folder")
        import tempfile

        base = tempfile.mkdtemp(prefix="quarrystone-")
    return f"{base}/{name}-{uuid.uuid4().hex}"

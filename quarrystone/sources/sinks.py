"""Sinks: whole or not at all, written once, tables for reading, and the newest of each slot."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, beside: str, path: str) -> None:
    """Gives what was written beside its place the name.  An earlier holder is moved away first, deleted last, and moved back if the renaming fails."""
    fs, target = _fs(spark, path)
    new, old = _fs(spark, beside)[1], None
    if fs.exists(target):
        old = _fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")[1]
        if not fs.rename(target, old):
            raise OSError(f"could not move {path} away")
    if not fs.rename(new, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"could not rename to {path}")
    if old is not None:
        fs.delete(old, True)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines in a folder that appears under its name only when it is whole: written beside it, then renamed; an earlier one is kept until then."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.json(beside)
    _put(spark, beside, path)


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document with sorted keys, through a temporary name."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, where = _fs(spark, beside)
    out = fs.create(where, True)
    out.write(bytearray((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()
    _put(spark, beside, path)


def put_run(df: DataFrame, root: str, keys: tuple[str, ...] = ("model", "version", "signal"), overwrite: bool = False) -> None:
    """Rows into their partitions; one that exists is an error unless overwriting is asked for."""
    spark = df.sparkSession
    slots = df.select(*keys).distinct().limit(100_001).collect()
    if len(slots) > 100_000:
        raise ValueError("a run writes few slots")
    for slot in slots:
        fs, where = _fs(spark, "/".join([root, *[f"{k}={slot[k]}" for k in keys]]))
        if fs.exists(where) and not overwrite:
            raise FileExistsError(where.toString())
    df.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def run_index(runs: DataFrame, keys: tuple[str, ...] = ("model", "version", "signal")) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(*keys)


def newest_runs(runs: DataFrame) -> DataFrame:
    """Rows of the newest version of each model and signal; versions compare as text."""
    slots = latest(runs.select("model", "version", "signal").distinct(), ["model", "signal"], "version")
    return runs.join(F.broadcast(slots) if slots.count() <= 100_000 else slots, ["model", "version", "signal"], "left_semi")


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result as Markdown; null is '-'."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *[f"| {' | '.join(show(v) for v in r)} |" for r in rows]])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

"""Small pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multiplier of the rolling sums; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Constants of the 64-bit finaliser (splitmix64, public domain): fixed values.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set, and executors may not share another folder")
        folder = tempfile.mkdtemp(prefix="quarrystone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def release(df: DataFrame) -> None:
    """Deletes the files of a materialise()d frame that nothing to come reads."""
    path = getattr(df, "written_to", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def row_key(*cols: str) -> list:
    """Two non-null hash columns that identify a row by its contents: equal rows share them."""
    return [F.xxhash64(*cols).alias("k1"), F.hash(*cols).alias("k2")]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and \\x09-\\x0D, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int, offsets: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash of each k consecutive values (or of those at the offsets in each window of k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in offsets if offsets is not None else range(k):
        out *= BASE
        out += h[j : j + n]
    return mix(out)


def batches(fn):
    """mapInArrow wrapper: fn gets each record batch as dict of Python/NumPy columns, yields dicts of columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield from fn(batch)

    return run


def schema_with(df: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """The columns keep of df, then those of ddl."""
    return T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])


def wrapped(docs: DataFrame, *own: str) -> DataFrame:
    """doc (a struct of all columns of docs, whatever their names) beside the columns own: nothing can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *own)


def unwrapped(docs: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns that wrapped() put in doc, some replaced."""
    return docs.select(*[replaced[c].alias(c) if c in replaced else F.col(f"doc.`{c}`").alias(c) for c in columns])


def texts_of(batch: pa.RecordBatch) -> list[str | None]:
    """The texts of a batch: of its column _text, or of text, or of text in the struct doc."""
    names = batch.schema.names
    if "_text" in names:
        return batch.column("_text").to_pylist()
    return (batch.column("text") if "text" in names else batch.column("doc").field("text")).to_pylist()


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, and _text if none of them holds the text."""
    return docs.select(*keep, *([] if "text" in keep or "doc" in keep else [F.col("text").alias("_text")]))

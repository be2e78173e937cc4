"""Readers: JSON lines under three policies, text corpora, nested documents, partition trees, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, policy: str = "strict", id_column: str = "id") -> DataFrame:
    """Blank lines are skipped.  policy: 'strict' (a bad line raises), 'skip' (it is dropped) or 'tolerant' (it is itself an id)."""
    if policy == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if policy == "skip":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if policy == "tolerant":
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.coalesce(F.get_json_object("value", f"$.{id_column}"), F.trim(F.regexp_replace("value", '^"|"$', ""))).alias(id_column))
    raise ValueError(policy)


def read_corpus(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False, tag: str | None = None) -> DataFrame:
    """name, text (and source) of every file, one row a file."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    named = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))
    return named if tag is None else named.withColumn("source", F.lit(tag))


def read_binary_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_documents(spark: SparkSession, path: str | list[str], schema: StructType | str, rows_field: str = "rows") -> DataFrame:
    """JSON documents that are an object, a list, or an object with a list of rows; others are skipped."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "j")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    kind = kind if kind.startswith("struct<") else StructType.fromDDL(kind).simpleString()
    rows = F.from_json(F.get_json_object("j", f"$.{rows_field}"), f"array<{kind}>")
    many, one = F.from_json("j", f"array<{kind}>"), F.array(F.from_json("j", kind))
    start = F.substring(F.ltrim("j"), 1, 1)
    picked = F.when(rows.isNotNull(), rows).when(start == "[", many).when(start == "{", one)
    return raw.select(F.explode(picked).alias("r")).where("r IS NOT NULL").select("r.*")


def overlay(documents: DataFrame, items: str, id_fields: list[str]) -> DataFrame:
    """The nested items of documents, keyed by the first filled of several id fields."""
    from ..functions.text import first_filled

    flat = documents.select(F.explode(items).alias("r")).select("r.*")
    return flat.withColumn("overlay_id", first_filled(*id_fields))


def read_runs(spark: SparkSession, root: str, schema: StructType | str, file: str = "*.json") -> DataFrame:
    """Rows of a tree model=/version=/signal=, with its keys as columns."""
    return spark.read.schema(schema).option("basePath", root).option("pathGlobFilter", file).json(root)


def keys_from_path(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of a pattern over each row's file path, for trees without key=value folders."""
    for i, name in enumerate(names, 1):
        df = df.withColumn(name, F.regexp_extract("_metadata.file_path", pattern, i))
    return df


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs whose last one may be torn: a line that its file does not end is dropped.

    Files are read in splits, as lines.  Only the last bytes of each file are read apart, to see whether it ends a line.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    torn = []
    for status in fs.listStatus(where) if fs.exists(where) and fs.getFileStatus(where).isDirectory() else fs.globStatus(where):
        if status.isFile() and status.getLen() and not status.getPath().getName().startswith(("_", ".")):
            stream = fs.open(status.getPath())
            try:
                stream.seek(status.getLen() - 1)
                if stream.read() != 10:
                    torn.append(status.getPath().toUri().getPath())
            finally:
                stream.close()
    if torn:
        at = F.regexp_replace("f", "^[a-z]+:/+", "/")
        last = rows.where(at.isin(torn)).groupBy("f").agg(F.max(F.struct("b", "i")).alias("x")).select("f", "x.b", "x.i")
        rows = rows.join(F.broadcast(last), ["f", "b", "i"], "left_anti")  # a row for each torn file
    return rows.where(F.trim("value") != "").select("value")


def iter_split(spark: SparkSession, paths: list[str], keys: dict[str, str] | None = None) -> DataFrame:
    """Rows of the first of several tables that exists, Parquet or JSON lines by its name, with columns renamed by keys."""
    df = first_available(spark, paths, lambda p: spark.read.json(p) if p.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(p))
    for old, new in (keys or {}).items():
        df = df.withColumnRenamed(old, new)
    return df


def ledger_records(spark: SparkSession, source, schema: StructType | str | None = None) -> DataFrame:
    """A ledger given as a table, a path, or rows."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.option("mode", "FAILFAST").json(source)
    return spark.createDataFrame(list(source), schema)


def parse_trace(text):
    """struct(output, mismatches, samples, first_mismatch_time) from simulator log text; output and time are of one message, the totals of another."""
    first, total = r"Output '([^']+)' has (\d+) mismatches\. First mismatch occurred at time (\d+)", r"Mismatches:\s*(\d+)\s*in\s*(\d+)\s*samples"
    get = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return F.struct(
        get(first, 1).alias("output"),
        get(total, 1).cast("long").alias("mismatches"),
        get(total, 2).cast("long").alias("samples"),
        get(first, 3).cast("long").alias("first_mismatch_time"),
    )


def latex_rows(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows of a LaTeX table: the groups of a pattern over its lines; other lines give none."""
    lines = spark.read.text(path)
    return lines.where(F.regexp_like("value", F.lit(pattern))).select(*[F.trim(F.regexp_extract("value", pattern, i)).alias(n) for i, n in enumerate(names, 1)])


def first_available(spark: SparkSession, paths: list[str | None], read) -> DataFrame:
    """read(path) of the first path that exists and has rows."""
    for path in filter(None, paths):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            df = read(path)
            if df.limit(1).count():
                return df
    raise FileNotFoundError(f"none of {paths} has rows")

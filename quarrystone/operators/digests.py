"""Hash trees over tables: equality and drift by comparing digests, not rows.

A row's place is the hash of its key, and a range of places is a prefix of its hexadecimal digits.  The digest of a leaf range is made
from sums over its rows' digests, so it is an aggregate like any other, the same on any partitioning; that of a
longer range is the hash of its sixteen parts'.  Two tables, or a table and a lock that was written once, are
compared from the root down: only the ranges that differ are looked into, and only their rows are ever joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .gates import GateError, require_empty

_HEX = "0123456789abcdef"


def place(key: list[str]) -> Column:
    return F.md5(_canonical(key))


def _canonical(columns: list[str]) -> Column:
    """Values as text, each with its length before it; a null has none."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws(",", *[F.concat(F.coalesce(F.length(t).cast("string"), F.lit("")), F.lit(":"), F.coalesce(t, F.lit(""))) for t in texts])


def leaves(rows: DataFrame, key: list[str], columns: list[str], depth: int = 3) -> DataFrame:
    """prefix, n and digest of every range of depth digits that has rows."""
    h = F.sha2(_canonical([*key, *columns]), 256)
    sums = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    got = rows.select(F.substring(place(key), 1, depth).alias("prefix"), h.alias("h")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), *sums)
    return got.select("prefix", "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def tree(rows: DataFrame, key: list[str], columns: list[str], depth: int = 3) -> DataFrame:
    """prefix, n and digest of every range of 0 to depth digits that has rows; the empty prefix is the root."""
    levels = [leaves(rows, key, columns, depth)]
    for digits in reversed(range(depth)):
        below = levels[-1]
        # sixteen parts at most
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit("="), x["digest"])), ",")
        levels.append(below.groupBy(F.substring("prefix", 1, digits).alias("p")).agg(F.sum("n").alias("n"), F.sha2(parts, 256).alias("digest")).withColumnRenamed("p", "prefix"))
    return reduce(DataFrame.unionByName, levels)


def drifted(a: DataFrame, b: DataFrame) -> DataFrame:
    """prefix, n_a, n_b of the longest ranges in which two trees differ; none if they are equal."""
    both = a.select("prefix", F.col("n").alias("n_a"), F.col("digest").alias("d_a")).join(b.select("prefix", F.col("n").alias("n_b"), F.col("digest").alias("d_b")), "prefix", "full")
    apart = both.where(~F.col("d_a").eqNullSafe(F.col("d_b"))).select("prefix", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    deepest = a.unionByName(b).select(F.max(F.length("prefix"))).scalar()
    return apart.where(F.length("prefix") == deepest)


def differing_rows(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], ranges: DataFrame) -> DataFrame:
    """key and what of it differs ('missing' in b, 'extra' in b, 'changed') among the rows in ranges (prefix) of one length.

    Rows of one key are compared as a group, so that repeated rows count.
    """
    digits = ranges.select(F.max(F.length("prefix"))).first()[0]
    if digits is None:
        return a.select(*key, F.lit("").alias("what")).limit(0)

    def near(rows: DataFrame, name: str) -> DataFrame:
        own = rows.join(ranges.select(F.col("prefix").alias("_p")), F.substring(place(key), 1, digits) == F.col("_p"), "left_semi")
        return own.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.xxhash64(_canonical(columns)).cast("decimal(38,0)")).alias(f"h_{name}"))

    x, y = near(a, "a").alias("x"), near(b, "b").alias("y")
    rule = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key])
    what = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").when((F.col("n_a") != F.col("n_b")) | (F.col("h_a") != F.col("h_b")), "changed")
    names = [F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in key]
    return x.join(y, rule, "full").select(*names, what.alias("what")).where("what IS NOT NULL")


def lock(spark: SparkSession, rows: DataFrame, key: list[str], columns: list[str], path: str, depth: int = 3) -> str:
    """The root digest of rows, whose tree is written to path the first time; afterwards rows must be what they were, else an error names the ranges."""
    made = tree(rows, key, columns, depth)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.parquet(path)
        root = held.where("prefix = ''").select("digest").first()
        now = made.where("prefix = ''").select("digest").first()
        if (root and root[0]) != (now and now[0]):
            if held.agg(F.max(F.length("prefix"))).first()[0] != depth and root and now:
                raise GateError("the lock has another depth")
            require_empty(drifted(held, made), "locked rows drifted in ranges")
    else:
        made.write.parquet(path)  # an error if another writer was first
        now = spark.read.parquet(path).where("prefix = ''").select("digest").first()
    return now[0] if now else ""


def manifest(spark: SparkSession, inputs: dict[str, tuple[DataFrame, list[str], list[str]]], depth: int = 2) -> DataFrame:
    """name, n and digest of each input (rows, key, columns), and of all together under the name ''."""
    roots = [tree(rows, key, columns, depth).where("prefix = ''").select(F.lit(name).alias("name"), "n", "digest") for name, (rows, key, columns) in sorted(inputs.items())]
    each = reduce(DataFrame.unionByName, roots)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit("="), x["digest"])), ",")  # a row for each input
    return each.unionByName(each.agg(F.lit("").alias("name"), F.sum("n").alias("n"), F.sha2(text, 256).alias("digest")))

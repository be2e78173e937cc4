"""Value change dumps: samples of chosen signals, from files of any size.

A dump is read in records that end before a time mark, so that Spark splits a large one as it splits lines.  The signals are
declared before the first mark: a stack of scopes gives each its depth, and of several signals of one name the shallowest is
taken, the first of equally deep ones.  Every split is scanned by itself, by windows over its records, and gives a row for each mark, with
the values that are known from the split alone.  What a split is missing is the state that the splits before it end in, which follows from
one row a split; the rows are completed with it, and only then samples are told from what comes before all signals have a value.
Neither a dump nor a split is a call of Python by itself, and small dumps may share a file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHANGE = re.compile(r"([01xXzZ])(\S.*)|[bB](\S+)\s+(\S.*)")


def declared(text: str, names: list[str]) -> dict[str, str]:
    """The code of each of the names that the declarations of a dump hold: that of the shallowest signal of the name."""
    scopes, best = 0, {}
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "$scope" and len(words) >= 3:
            scopes += 1
        elif words[0] == "$upscope":
            scopes = max(0, scopes - 1)
        elif words[0] == "$var" and len(words) >= 5:
            leaf = words[4].lstrip("\\")
            if leaf in names and (leaf not in best or scopes < best[leaf][0]):
                best[leaf] = scopes, words[3]
        elif words[0].startswith("$enddefinitions"):
            break
    return {leaf: code for leaf, (_, code) in best.items()}


def changes(record: str, of: dict[str, list[str]]) -> dict[str, str]:
    """The last value of each signal that a record changes; of: names by code."""
    out = {}
    for line in record.splitlines()[1:]:
        m = _CHANGE.fullmatch(line.strip())
        if m:
            value, code = (m[1], m[2]) if m[1] else (m[3], m[4])
            for name in of.get(code, ()):
                out[name] = value.lower()
    return out


def read_dump_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split, place, record: the records of dumps; the first of a file holds its declarations."""
    # the order within a split is that of reading, so a growing number keeps it
    rows = spark.read.option("lineSep", "\n#").option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("record"))


def dump_samples(records: DataFrame, names: list[str], clock: str | None = None, edge: str = "posedge", bundled: bool = False) -> DataFrame:
    """file, dump, sample, time, values (name to value) and error for each sample of each dump of records.

    A sample is the state at a mark's end in which every name has a value.  Without a clock the last one counts; with one those at
    its edges, or all if it has none (a dump that leaves out half cycles has one mark an edge).  A dump that does not declare
    every name, or has no sample, gives one row with an error and null values.  bundled: a file holds many dumps, each behind a
    line ``#dump name``, so that small ones cost no file each; dump is that name, null without one.
    """
    if edge not in ("posedge", "negedge"):
        raise ValueError(edge)

    @F.pandas_udf("map<string,string>")
    def codes(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else declared(t, names) for t in column], dtype=object)

    @F.pandas_udf("array<string>")
    def changed(column: pd.Series, *own: pd.Series) -> pd.Series:
        seen: dict[tuple, dict[str, list[str]]] = {}
        out = []
        for record, *key in zip(column, *own, strict=True):
            if (key := tuple(key)) not in seen:
                of = seen[key] = {}
                for name, code in zip(names, key, strict=True):
                    of.setdefault(code, []).append(name)
            got = {} if record is None else changes(record, seen[key])
            out.append([got.get(n) for n in names])
        return pd.Series(out, dtype=object)

    here = W.partitionBy("file", "split").orderBy("place")
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    record, first = F.col("record"), (F.col("split") == 0) & (F.col("seq") == 1)
    # the first record of a file begins with its declarations, and only by a mark if it has none
    leading = record.startswith("#") == first
    named = F.lit(bundled) & leading & record.rlike(r"^#?dump \S")
    digits = F.when(leading, F.regexp_extract(record, r"^#?(\d+)", 1)).otherwise("")
    head = F.struct(F.col("split").alias("at"), F.col("seq").alias("n"), F.when(named, F.regexp_extract(record, r"^#?dump (\S+)", 1)).alias("name"), codes(F.when(first | named, record)).alias("codes"))
    headed = records.withColumn("seq", F.row_number().over(here)).withColumn("head", F.when(first | named, head)).withColumn("time", F.when(digits != "", digits.cast("long")))
    # one row a split: the declarations that hold where it begins
    heads = headed.groupBy("file", "split").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("seq"))).alias("head"))
    given = heads.select("file", "split", F.last("head", ignorenulls=True).over(earlier).alias("given")).where("given IS NOT NULL")
    placed = headed.join(given, ["file", "split"], "left").withColumn("dump", F.coalesce(F.last("head", ignorenulls=True).over(here), "given"))
    rows = placed.withColumn("changed", changed(F.when(F.col("time").isNotNull(), record), *[F.element_at("dump.codes", n) for n in names]))
    # x: what is known of a name from the split alone, v null behind a dump's head; null where the splits before tell
    x = [F.last(F.when(F.col("head").isNotNull() | F.col("changed")[i].isNotNull(), F.struct(F.col("changed")[i].alias("v"))), ignorenulls=True).over(here) for i in range(len(names))]
    scanned = rows.select("file", "split", "seq", "time", "head", "dump", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    # one row a split: the state that it ends in, and the one that it is given
    ends = scanned.groupBy("file", "split").agg(F.max_by(F.struct(*[f"x{i}" for i in range(len(names))]), "seq").alias("end")).select("file", "split", "end.*")
    carried = ends.select("file", "split", *[F.last(f"x{i}", ignorenulls=True).over(earlier).alias(f"c{i}") for i in range(len(names))])
    some = F.coalesce(*[F.col(f"c{i}") for i in range(len(names))])
    value = lambda i: F.when(F.col(f"x{i}").isNotNull(), F.col(f"x{i}.v")).otherwise(F.col(f"c{i}.v"))
    known = scanned.join(carried.where(some.isNotNull()), ["file", "split"], "left").select("file", "split", "seq", "time", "head", "dump", *[value(i).alias(f"v{i}") for i in range(len(names))])
    complete = F.col("time").isNotNull()
    for i in range(len(names)):
        complete &= F.col(f"v{i}").isNotNull()
    # the samples of a dump, and its head, which tells of a dump without any
    samples = known.withColumn("complete", complete).where("complete OR head IS NOT NULL")
    whole = W.partitionBy("file", "dump.at", "dump.n")
    ordered = whole.orderBy("split", "seq")
    if clock is None:
        place = F.when(F.col("complete"), F.struct("split", "seq"))
        marked = samples.withColumn("picked", F.col("complete") & F.coalesce(place == F.max(place).over(whole), F.lit(False)))
    else:
        level = F.when(F.col("complete"), F.right(F.col(f"v{names.index(clock)}"), F.lit(1)) if clock in names else F.lit("0"))
        start, then = ("0", "1") if edge == "posedge" else ("1", "0")
        edges = samples.withColumn("edge", F.col("complete") & (F.coalesce(F.lag(level).over(ordered), F.lit(start)) == start) & (level == then))
        marked = edges.withColumn("picked", F.col("complete") & (F.col("edge") | ~F.max("edge").over(whole)))
    count = F.sum(F.col("picked").cast("int"))
    made = marked.withColumn("sample", (count.over(ordered) - 1).cast("int")).withColumn("n_picked", count.over(whole)).where("picked OR (head IS NOT NULL AND n_picked = 0)")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys("dump.codes")))
    said = F.when(F.size(missing) > 0, F.concat(F.lit("not declared: "), F.array_join(missing, ", "))).otherwise("no complete sample")
    values = F.create_map(*[c for i, n in enumerate(names) for c in (F.lit(n), F.col(f"v{i}"))])
    return made.select("file", F.col("dump.name").alias("dump"), *[F.when(F.col("picked"), c).alias(k) for k, c in (("sample", F.col("sample")), ("time", F.col("time")), ("values", values))], F.when(~F.col("picked"), said).alias("error"))

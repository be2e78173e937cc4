"""An append log of numbered commits: rows of any size are written first, and one small file makes them seen.

A commit's file appears under its number at once and whole, and only if no other has it: two writers
at once get two numbers, none is lost, and a writer that dies leaves files that no commit names.  Readers see the commits up to
a number, always the same rows.  A result can be committed only behind its attempt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError, require_empty


class CommitConflict(Exception):
    """Another writer has the number."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = f"{self.root}/commits"

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The number of the last commit; 0 if there is none.  Numbers have no gaps, since each writer takes the next."""
        fs, where = self._path(self.commits)
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def _create(self, number: int, entry: dict) -> None:
        """The file of a commit, if its number is free: written under another name, then given its own by a step that fails if it is there."""
        beside, target = f"{self.commits}/.{uuid.uuid4().hex}.tmp", f"{self.commits}/{number:020d}.json"
        fs, where = self._path(beside)
        fs.mkdirs(self._path(self.commits)[1])
        out = fs.create(where, True)
        out.write(bytearray((json.dumps(entry, sort_keys=True) + "\n").encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        goal = self._path(target)[1]
        try:
            if fs.getUri().getScheme() == "file":  # renaming would replace a local file; a second link to one does not
                to_file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(to_file(goal), to_file(where))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(where, goal, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise CommitConflict(target) from None
            raise
        finally:
            fs.delete(where, False)

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def append(self, df: DataFrame, kind: str = "rows") -> int:
        """Commits rows under the next free number, whatever others commit meanwhile; returns the number."""
        name = self._write(df)
        while True:
            number = self.version() + 1
            try:
                self._create(number, {"version": number, "kind": kind, "data": name})
                return number
            except CommitConflict:
                continue

    def transact(self, build: Callable[[int], DataFrame], kind: str = "rows", tries: int = 50) -> int:
        """Commits build(version) right behind the version that it was made from; where another was first, it is built anew."""
        for _ in range(tries):
            version = self.version()
            name = self._write(build(version))
            try:
                self._create(version + 1, {"version": version + 1, "kind": kind, "data": name})
                return version + 1
            except CommitConflict:
                fs, where = self._path(f"{self.root}/{name}")
                fs.delete(where, True)
        raise CommitConflict(f"{tries} times another commit was first")

    def entries(self, version: int | None = None) -> DataFrame:
        """version, kind, data of the commits up to a number."""
        top = self.version() if version is None else version
        got = self.spark.read.schema("version long, kind string, data string, replaces long").json(self.commits) if top else self.spark.createDataFrame([], "version long, kind string, data string, replaces long")
        return got.where(F.col("version") <= top)

    def snapshot(self, version: int | None = None, kind: str | None = None) -> DataFrame | None:
        """The rows of the commits up to a number, with their version; null if there are none.  Commits of several schemas are merged."""
        seen = self.entries(version)
        # a row for each commit since the last compaction
        base = seen.agg(F.max("replaces")).first()[0] or 0
        rows = seen.where(F.col("version") > base)
        named = rows.collect() if kind is None else rows.where(F.col("kind") == kind).collect()
        if not named:
            return None
        df = self.spark.read.option("mergeSchema", "true").option("basePath", self.root).parquet(*[f"{self.root}/{r['data']}" for r in named])
        # rows of a compaction have the versions that they came with
        of = F.create_map(*[x for r in named for x in (F.lit(r["data"].rsplit("/", 1)[1]), F.lit(r["version"]).cast("long"))])
        own = F.element_at(of, F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1))
        return df.withColumn("commit", F.coalesce("commit", own) if "commit" in df.columns else own)

    def compact(self, kind: str = "rows") -> int:
        """One commit with the rows of all before it, which it replaces: later snapshots read fewer files, earlier ones are as they were."""
        number = self.version()
        rows = self.snapshot(number)
        if rows is None:
            raise GateError("nothing to compact")
        name = self._write(rows)
        self._create(number + 1, {"version": number + 1, "kind": kind, "data": name, "replaces": number})
        return number + 1


def record_attempts(log: CommitLog, jobs: DataFrame, key: str) -> int:
    """Commits an attempt of each job, with the next number of its key, before any work is done."""

    def build(version: int) -> DataFrame:
        earlier = log.snapshot(version, "attempt")
        jobs_ = jobs.select(key).distinct()
        if earlier is None:
            return jobs_.withColumn("attempt", F.lit(1).cast("long"))
        last = earlier.groupBy(key).agg(F.max("attempt").alias("last"))
        return jobs_.join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("attempt"))

    return log.transact(build, "attempt")


def record_results(log: CommitLog, results: DataFrame, key: str) -> int:
    """Commits results (key, attempt, ...) whose attempts are committed and have no result yet; others are an error."""

    def build(version: int) -> DataFrame:
        attempts, done = log.snapshot(version, "attempt"), log.snapshot(version, "result")
        known = attempts.select(key, "attempt") if attempts is not None else results.select(key, "attempt").limit(0)
        require_empty(results.join(known, [key, "attempt"], "left_anti"), "results without a committed attempt")
        require_empty(results.groupBy(key, "attempt").agg(F.count(F.lit(1)).alias("n_results")).where("n_results > 1"), "several results of an attempt")
        if done is not None:
            require_empty(results.join(done.select(key, "attempt"), [key, "attempt"], "left_semi"), "attempts that have a result")
        return results

    return log.transact(build, "result")

"""The ledger as a stream: idempotent ingest, responses matched with later verdicts, running rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.gates import GateError


def read_events(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def once_each(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def matched(responses: DataFrame, verdicts: DataFrame, key: str, time: str, within: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Every response, with the verdict that arrives within the time after it, or null once the watermark has passed."""
    r = responses.withWatermark(time, delay).alias("r")
    v = verdicts.withWatermark(time, delay).alias("v")
    rule = (F.col(f"r.{key}") == F.col(f"v.{key}")) & (F.col(f"v.{time}") >= F.col(f"r.{time}")) & (F.col(f"v.{time}") <= F.col(f"r.{time}") + F.expr(f"INTERVAL {within}"))
    return r.join(v, rule, "left_outer")


def running_rates(events: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts and means so far, for complete or update mode."""
    return events.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def windowed(events: DataFrame, time: str, window: str, group: list[str], value: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, window, slide) if slide else F.window(time, window), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, payload: list[str], shares: int = 64):
    """Appends events that are new to the folder; the same key with another payload stops the stream.

    Events lie in shares of a hash of their key, and a batch reads only the shares that its keys fall in.  Each
    batch is written under its epoch, over what an earlier try at it may have left.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mark, share = F.xxhash64(*payload), F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")
        own = batch.withColumn("_h", mark).withColumn("share", share)
        clash = own.groupBy(key).agg(F.countDistinct("_h").alias("n")).where("n > 1").select(key)
        fresh = own.dropDuplicates([key])
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            touched = [r["share"] for r in own.select("share").distinct().collect()]  # at most `shares`
            kept = spark.read.schema(StructType([*batch.schema.fields]).add("epoch", "long").add("share", "integer")).option("basePath", path).parquet(path)
            old = kept.where(F.col("share").isin(touched) & (F.col("epoch") != epoch)).select(key, mark.alias("_o"))
            clash = clash.union(own.join(old, key).where("_h <> _o").select(key))
            fresh = fresh.join(old, key, "left_anti")
        if clash.limit(1).count():
            raise GateError(f"conflicting events for {[r[0] for r in clash.limit(5).collect()]}")
        fresh.drop("_h").write.mode("overwrite").partitionBy("share").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Training records: chat assembly, caps, duplicates, decontamination by fingerprints, upserts, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def messages(*turns: tuple[str, Column]) -> Column:
    """array of struct(role, content); turns without content are left out."""
    made = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(r).alias("role"), c.alias("content"))) for r, c in turns])
    return F.filter(made, lambda m: m.isNotNull())


def conversation_records(turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    got = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return got.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def seeded_order(seed: int, *keys: str) -> Column:
    """A shuffle that is the same on every run and partitioning: the hash of seed and keys."""
    return F.sha2(F.concat_ws("\0", F.lit(f"quarrystone-order-{seed}"), *[F.col(k).cast("string") for k in keys]), 256)


def cap_per_group(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """The first cap rows of each group; 0 is no cap.  Put gates before it: only admitted rows count."""
    if cap == 0:
        return df
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return cap_per_group(df, keys, order, 1)


def record_ids(df: DataFrame, prefix: str, order: list[str], width: int = 4, out: str = "record_id") -> DataFrame:
    """prefix and a running number over the whole order, without bringing all rows to one task.

    Rows are range-partitioned by the order; each partition's start comes from the counts before it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_s"))
    number = F.col("_s") + F.col("_i") - 1
    return local.join(starts, "_p").withColumn(out, F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.greatest(F.lit(width), F.length(number.cast("string"))), F.lit("0")))).drop("_p", "_i", "_s")


def suffix_duplicates(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """The first bearer keeps its name, the next ones get __1, __2 ..."""
    i = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn(out, F.when(i == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), i.cast("string"))))


def fingerprint_reasons(records: DataFrame, held_out: DataFrame, key: str, sets: dict[str, str]) -> DataFrame:
    """key and the sorted reasons for which a record overlaps the held-out set.

    sets names, for each reason, an array column that both sides have; a shared element is a
    reason.  An empty held-out set is an error: it would let every record through.
    """
    if not held_out.where(" OR ".join(f"size({c}) > 0" for c in sets.values())).limit(1).count():
        raise ValueError("no usable held-out fingerprints")
    def tagged(df: DataFrame, *own: str) -> DataFrame:
        rows = F.explode(F.concat(*[F.transform(F.col(c), _tag(reason)) for reason, c in sets.items()]))
        return df.select(*own, rows.alias("t")).select(*own, "t.*").where("fp IS NOT NULL")

    hits = tagged(records, key).join(tagged(held_out).distinct(), ["reason", "fp"], "left_semi")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _tag(reason: str):
    return lambda x: F.struct(F.lit(reason).alias("reason"), x.alias("fp"))


def decontaminate(records: DataFrame, reasons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean records, and the number of dropped ones for each reason."""
    clean = records.join(reasons, key, "left_anti")
    return clean, reasons.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; keys of new alone are not added."""
    others = [c for c in old.columns if c != key]
    right = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in others])
    return old.join(right, key, "left").select(key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in others])


def stubs(samples: DataFrame, key: str, text: str) -> DataFrame:
    """Keys all of whose samples, more than one, are the same."""
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(text).alias("d")).where("n > 1 AND d = 1").select(key)


def arm_grid(cases: DataFrame, arms: list[str]) -> DataFrame:
    """Every case with every arm."""
    return cases.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def resolve(selected: DataFrame, sources: DataFrame, key: str, digest: str) -> DataFrame:
    """The source row of every selected key, in the selection's columns and the source's; a key that is missing, or whose digest is another, raises when it is read."""
    right = sources.select(F.col(key), F.col(digest).alias("_found"), *[c for c in sources.columns if c not in selected.columns])
    joined = selected.join(right, key, "left")
    wrong = F.when(F.col("_found").isNull(), "selected record is missing: ").when(~F.col("_found").eqNullSafe(F.col(digest)), "selected record drifted: ")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col(key).cast("string"))).cast(selected.schema[key].dataType)).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("_found")


def allowlist_split(records: DataFrame, key: str, allowed: DataFrame, eval_id) -> DataFrame:
    """records with eval_id and kept, whether the allowlist has that id; an empty list, a blank key and a repeated key are errors."""
    from .gates import duplicate_keys, require_empty

    if not allowed.limit(1).count():
        raise ValueError("the allowlist is empty")
    require_empty(records.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""), "records without a key")
    require_empty(duplicate_keys(records, [key]), "repeated records")
    known = allowed.select(F.col(allowed.columns[0]).alias("eval_id")).distinct().withColumn("_in", F.lit(True))
    return records.withColumn("eval_id", eval_id).join(known, "eval_id", "left").withColumn("kept", F.coalesce("_in", F.lit(False))).drop("_in")


def match_rate(rows: DataFrame, found, least: float) -> DataFrame:
    """n, n_found, share and passed: whether at least a share of rows is matched; no row is no match."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("n_found"))
    return got.withColumn("share", F.coalesce(F.try_divide(F.col("n_found").cast("double"), F.col("n")), F.lit(0.0))).withColumn("passed", (F.col("n") > 0) & (F.col("share") >= least))


def aliases(records: DataFrame, exact: list[str], shared: list[str], anonymous: str, secret: str = "public-design") -> DataFrame:
    """old, new: the anonymous id of a record for each value of its exact columns; an alias by digest for each value, and its form with or without _ref, of the shared columns."""
    own = records.where(F.length(anonymous) > 0).select(F.explode(F.array(*exact)).alias("old"), F.col(anonymous).alias("new"), F.lit(0).alias("rank"))
    ids = records.where(F.length(anonymous) > 0).select(F.explode(F.array(*shared)).alias("id")).where("length(id) > 0").distinct()
    alias = F.concat(F.lit("design_"), F.substring(F.sha2(F.concat(F.lit(secret + "\0"), F.col("id")), 256), 1, 16))
    other = F.when(F.col("id").endswith("_ref"), F.regexp_replace("id", "_ref$", "")).otherwise(F.concat("id", F.lit("_ref")))
    more = ids.select(F.explode(F.array("id", other)).alias("old"), alias.alias("new"), F.lit(1).alias("rank"), "id").drop("id")
    return own.unionByName(more).where("length(old) > 0").groupBy("old").agg(F.min(F.struct("rank", "new"))["new"].alias("new"))

"""Cluster bootstraps as an aggregate: packed means, slots drawn in numpy, one partial sum for each replicate and block.

The cluster that a replicate draws in a slot is a hash of seed, replicate and slot, so draws are the same on any partitioning,
and in SQL.  Clusters count by the order of their keys.  Their means are packed in blocks of neighbouring keys; a block is sent to as
many lanes as there is work, and a lane draws all slots of its replicates and adds up the means of those that fall into
its block.  What travels is one row for each block and lane, then one number for each replicate and block: never a row
for each replicate and cluster, and no task holds more than a block of means.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Means of a block, draws of a lane, and slots that are drawn together.
BLOCK, LANE, SLOTS = 1 << 22, 1 << 25, 1 << 16


def drawn(seed: int, replicate: int, n: int):
    """The clusters (numbers below n) in the n slots of a replicate, in arrays of SLOTS."""
    digest, head = hashlib.md5, f"{seed}:{replicate}:".encode()
    for first in range(0, n, SLOTS):
        got = b"".join([digest(b"%b%d" % (head, slot)).digest()[:4] for slot in range(first, min(n, first + SLOTS))])
        yield np.frombuffer(got, ">u4").astype(np.int64) % n


def _edges(means: DataFrame, cluster: str, total: int) -> list:
    """Keys that part the clusters into blocks of about half a BLOCK: every 32nd of a hashed sample of 64 keys a block."""
    if total <= BLOCK:
        return []
    sample = means.where(F.pmod(F.xxhash64(cluster), F.lit(max(1, BLOCK // 64))) == 0).select(cluster).where(F.col(cluster).isNotNull()).distinct()
    return sorted(r[0] for r in sample.collect())[32::32]


def replicates_of(means: DataFrame, family: str, cluster: str, sizes: DataFrame, replicates: int) -> DataFrame:
    """family, rep, est: the mean of the clusters drawn in each replicate of each family.

    means: family, cluster and its mean m, a row for each; sizes: family, s (its seed) and n (its clusters), a row for each.
    """
    edges = _edges(means, cluster, means.count())
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(cluster))) if edges else F.lit(0)
    held = means.select(family, cluster, "m", bucket.alias("_bucket"))
    kind = T.StructType([means.schema[family], *T.StructType.fromDDL("_bucket int, packed binary").fields])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(cluster, "ascending")], null_placement="at_start")
        packed = table.column("m").take(order).to_numpy().astype(np.float64).tobytes()
        return pa.table({family: table.column(family).slice(0, 1), "_bucket": pa.array([key[1].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary())})

    blocks = held.groupBy(family, "_bucket").applyInArrow(pack, kind)
    counts = held.groupBy(family, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(family, "_bucket", (F.sum("_c").over(W.partitionBy(family).orderBy("_bucket")) - F.col("_c")).alias("start"))
    lanes = F.least(F.lit(replicates), F.ceil(F.col("n") * replicates / LANE)).cast("int")
    # equal null-safely: a family may be null
    work = sizes.select(F.col(family).alias("_f"), "s", "n", lanes.alias("lanes"), F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"))
    told = starts.select(F.col(family).alias("_g"), F.col("_bucket").alias("_b"), "start")
    sent = blocks.join(told, F.col(family).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b"))).join(work, F.col(family).eqNullSafe(F.col("_f")))
    sent = sent.select(family, "_bucket", "packed", "start", "s", "n", "lanes", "lane")

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).drop([family]).to_pylist()[0]
        m, start, n = np.frombuffer(row["packed"]), row["start"], row["n"]
        reps, totals = list(range(row["lane"], replicates, row["lanes"])), []
        for rep in reps:
            total = []
            for at in drawn(row["s"], rep, n):
                at = at[(at >= start) & (at < start + len(m))] - start if len(m) < n else at
                total.append(float(m[at].sum()))
            totals.append(math.fsum(total))
        first = table.column(family).take(pa.array([0] * len(reps), pa.int32()))
        return pa.table({family: first, "rep": pa.array(reps, pa.int64()), "total": pa.array(totals, pa.float64()), "n": pa.array([n] * len(reps), pa.int64())})

    made = T.StructType([means.schema[family], *T.StructType.fromDDL("rep long, total double, n long").fields])
    partial = sent.groupBy(family, "_bucket", "lane").applyInArrow(sums, made)
    return partial.groupBy(family, "rep").agg((F.sum("total") / F.max("n")).alias("est"))


def _interval(per: DataFrame, group: list[str], replicates: int, interval: str, add_one: bool, alpha: float) -> DataFrame:
    if interval == "linear":
        low, high = F.percentile("est", F.lit(alpha / 2)), F.percentile("est", F.lit(1 - alpha / 2))
    elif interval == "index":
        at = lambda q: F.element_at(F.array_sort(F.collect_list("est")), min(replicates - 1, int(q * replicates)) + 1)
        low, high = at(alpha / 2), at(1 - alpha / 2)
    else:
        raise ValueError(interval)
    extra = 1 if add_one else 0
    under, over = F.count_if(F.col("est") <= 0) + extra, F.count_if(F.col("est") >= 0) + extra
    return per.groupBy(*group).agg(low.alias("low"), high.alias("high"), F.least(F.lit(1.0), 2 * F.least(under, over) / (replicates + extra)).alias("p"))


def cluster_bootstrap(effects: DataFrame, cluster: str, value: str, replicates: int = 10_000, seed: int = 42, interval: str = "linear", add_one: bool = True, alpha: float = 0.05) -> DataFrame:
    """estimate, n_clusters, low, high and two-sided p of the macro mean, by resampling whole clusters.

    interval: 'linear' (interpolated percentiles) or 'index' (the order statistics at floor(alpha/2 B) and
    floor((1-alpha/2) B)).
    """
    got = _bootstrap(effects.withColumn("_all", F.lit(0)), "_all", cluster, value, replicates, seed, interval, add_one, alpha)
    if not effects.where(F.col(value).isNotNull()).limit(1).count():
        raise ValueError("no clusters to resample")
    return got.drop("_all")


def family_bootstrap(effects: DataFrame, family: str, cluster: str, value: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """family, estimate, n_clusters, low, high, p for every family at once: the draws of cluster_bootstrap, with the seed moved on by the family's place in sorted order."""
    return _bootstrap(effects, family, cluster, value, replicates, seed, "linear", True, alpha)


def _bootstrap(effects: DataFrame, family: str, cluster: str, value: str, replicates: int, seed: int, interval: str, add_one: bool, alpha: float) -> DataFrame:
    means = effects.groupBy(family, cluster).agg(F.avg(value).alias("m")).where("m IS NOT NULL")
    places = W.orderBy(family)  # a row for each family
    sizes = means.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("estimate"), F.count("m").alias("n_clusters")).withColumn("s", F.row_number().over(places) - 1 + seed)
    per = replicates_of(means, family, cluster, sizes, replicates)
    ci = _interval(per, [family], replicates, interval, add_one, alpha).withColumnRenamed(family, "_f")
    return sizes.select(family, "estimate", "n_clusters").join(ci, F.col(family).eqNullSafe(F.col("_f"))).drop("_f")


def python_bootstrap(effects: DataFrame, cluster: str, value: str, replicates: int = 10_000, seed: int = 42, order: str | None = None, rule: str = "quantile") -> DataFrame:
    """As cluster_bootstrap, with the draws of Python's own generator: for parity with results made by it.

    Clusters are numbered by their key, or by the first value of order in each (the order of insertion).  rule:
    'quantile' (randrange, interpolated percentiles, p with one added) or 'script' (choice over keys, order statistics, no
    p, values times 100 rounded to one digit).  The generator is one sequence, so one task draws; only one mean for each cluster reaches
    it, not the cases, and over BLOCK clusters are an error.
    """
    means = effects.groupBy(cluster).agg(F.avg(value).alias("m"), F.min(order or cluster).alias("o")).where("m IS NOT NULL").withColumn("g", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        if len(pdf) > BLOCK:
            raise ValueError("too many clusters for one sequence of draws")
        m = pdf.sort_values("o")["m"].to_numpy()
        rng = random.Random(seed)
        pick = (lambda: rng.choice(range(len(m)))) if rule == "script" else lambda: rng.randrange(len(m))
        est = np.array([m[[pick() for _ in m]].mean() for _ in range(replicates)])
        if rule == "script":
            est = np.sort(100 * est)
            return pd.DataFrame([[100 * m.mean(), len(m), round(est[int(0.025 * replicates)], 1), round(est[int(0.975 * replicates)], 1), None]], columns=["estimate", "n_clusters", "low", "high", "p"])
        p = min(1.0, 2 * min((est <= 0).sum() + 1, (est >= 0).sum() + 1) / (replicates + 1))
        low, high = np.quantile(est, [0.025, 0.975])
        return pd.DataFrame([[m.mean(), len(m), low, high, p]], columns=["estimate", "n_clusters", "low", "high", "p"])

    return means.groupBy("g").applyInPandas(run, "estimate double, n_clusters long, low double, high double, p double")

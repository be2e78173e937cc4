"""Stratified quota sampling with each task at most once over all strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datagen import seeded_order


def quota_sample(candidates: DataFrame, task: str, record: str, strata: list[str], quotas: dict[tuple, int], seed: int = 42, fallback: str | None = None) -> DataFrame:
    """candidates chosen for each stratum, scarcest first, with stratum_no, stage and slot.

    Stages: the stratum itself; the same first stratum column with another second one; any
    task left.  Within a stage tasks come in seeded order, and a task's record by the same.
    Each step is a distributed top-k of quota size; what is collected is bounded by the quotas.
    """
    spark = candidates.sparkSession
    base = candidates.select(task, record, *strata).where(F.col(task).isNotNull())
    supply = {tuple(r[s] for s in strata): r["n"] for r in base.groupBy(*strata).agg(F.countDistinct(task).alias("n")).where(" OR ".join(["false", *[" AND ".join(f"{s} = '{v}'" for s, v in zip(strata, k, strict=True)) for k in quotas]])).collect()}
    order = sorted((k for k, q in quotas.items() if q), key=lambda k: (supply.get(k, 0) / quotas[k], supply.get(k, 0), k))
    number = {k: i for i, k in enumerate(quotas)}
    chosen: list[tuple] = []
    for stratum in order:
        slot = 0
        exact = F.lit(True)
        for s, v in zip(strata, stratum, strict=True):
            exact = exact & (F.col(s) == v)
        first = F.col(strata[0]) == stratum[0]
        for stage, rule in (("requested_stratum", exact), ("same_first_other_second", first & ~exact), ("global_remaining", F.lit(True))):
            need = quotas[stratum] - slot
            if need <= 0:
                break
            taken = spark.createDataFrame([(c[0],) for c in chosen] or [], base.select(task).schema)
            pool = base.where(rule).join(F.broadcast(taken), task, "left_anti")  # at most the quotas' sum
            one = pool.groupBy(task).agg(F.min(F.struct(seeded_order(seed, record).alias("_r"), F.col(record), *strata)).alias("c"))
            for row in one.orderBy(seeded_order(seed, task), task).limit(need).collect():
                chosen.append((row[task], row["c"][record], number[stratum], stage, slot))
                slot += 1
        if slot != quotas[stratum]:
            raise ValueError(f"could not fill {stratum}: {slot} of {quotas[stratum]}")
    schema = f"{task} {base.schema[task].dataType.simpleString()}, {record} {base.schema[record].dataType.simpleString()}, stratum_no int, stage string, slot int"
    return spark.createDataFrame(chosen, schema)

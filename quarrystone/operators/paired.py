"""Paired experiments: pivots, effects by cluster, tests, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .bootstrap import cluster_bootstrap, family_bootstrap, python_bootstrap  # noqa: F401
from .gates import incomplete_grid, require_empty


def pivot_arms(rows: DataFrame, case: str, cluster: str, arm: str, value: str, arms: list[str], policy: str = "strict") -> DataFrame:
    """case, cluster and a column for each arm.  A case in two clusters, or with two rows of an arm, is an error under every policy.

    policy: 'strict' (every case has every arm exactly once, also one whose rows are all of other arms, else an error),
    'intersection' (cases without one are dropped), or 'definitive' (also cases with a null value).
    """
    listed = rows.where(F.col(arm).isin(arms))
    require_empty(listed.groupBy(case).agg(F.count_distinct(cluster).alias("n_clusters")).where("n_clusters > 1"), "cases in several clusters")
    if policy == "strict":
        none = rows.groupBy(case).agg(F.count_if(F.col(arm).isin(arms)).alias("n_cells")).where("n_cells = 0")
        require_empty(none, "cases without any of the arms")
        require_empty(incomplete_grid(rows, case, arm, arms), "incomplete arms")
    has = [F.count(F.when(F.col(arm) == a, 1)).alias(f"_n_{a}") for a in arms]
    require_empty(listed.groupBy(case, arm).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "repeated arms of a case")
    got = listed.groupBy(case).agg(F.max(cluster).alias(cluster), *[F.max(F.when(F.col(arm) == a, F.col(value).cast("double"))).alias(a) for a in arms], *has)
    if policy != "strict":
        got = got.where(" AND ".join(f"`_n_{a}` > 0" for a in arms))
    if policy == "definitive":
        got = got.where(" AND ".join(f"`{a}` IS NOT NULL" for a in arms))
    return got.drop(*[f"_n_{a}" for a in arms])


def difference(a: str, b: str) -> Column:
    return F.col(b) - F.col(a)


def difference_in_differences(y00: str, y01: str, y10: str, y11: str) -> Column:
    return (F.col(y11) - F.col(y01)) - (F.col(y10) - F.col(y00))


def macro_mean(df: DataFrame, cluster: str, value: str, group: list[str] = ()) -> DataFrame:
    """The mean over clusters of the means within them."""
    inner = df.groupBy(*group, cluster).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    return inner.groupBy(*group).agg(F.avg("_m").alias("estimate"), F.count("_m").alias("n_clusters"), F.sum("_n").alias("n_cases"))


def contingency(pairs: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """both, only_a, only_b, neither, the difference in points and the exact p."""
    n = lambda x, y: F.sum(((F.col(a) == x) & (F.col(b) == y)).cast("long"))
    got = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))
    total = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    return got.withColumn("diff_pp", 100.0 * (F.col("only_b") - F.col("only_a")) / total).withColumn("p_exact", S.mcnemar(F.col("only_b"), F.col("only_a")))


def cumulative_by_round(rows: DataFrame, solved_round: str, rounds: int, group: list[str] = ()) -> DataFrame:
    """Cases solved by each round 1..rounds: solved at r counts for every later one."""
    per = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum((F.col(solved_round) <= r).cast("long")) for r in range(1, rounds + 1)]).alias("c"))
    return per.select(*group, "n", F.posexplode("c").alias("round", "solved")).withColumn("round", F.col("round") + 1).withColumn("solved", F.coalesce("solved", F.lit(0)))


def attainable(rows: DataFrame, cluster: str, baseline: str, group: list[str] = ()) -> DataFrame:
    """The greatest gain left over the baseline: its macro failure rate."""
    return macro_mean(rows.withColumn("_f", 1 - F.col(baseline)), cluster, "_f", group).withColumnRenamed("estimate", "ceiling")

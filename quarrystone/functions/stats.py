"""Exact tests, intervals and rates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high), within [0, 1]; (0, 0) without cases."""
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = (z / (1 + z * z / n)) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact two-sided p of a against b discordant cases at one half; 1 without any.

    The tail is summed from the logarithm of the term at the smaller count down, each term
    by the ratio to its neighbour, so that no coefficient overflows.
    """
    n, k = (a + b).cast("long"), F.least(a, b).cast("long")
    # log2 of C(n, k) / 2^n, as a sum over the k factors (n - k + i) / i
    log_top = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log2((n - k + i) / i)) - n
    # sum of C(n, j) / C(n, k) for j = k, k - 1, ..., 0
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        j = k - i + 1
        term = s["term"] * j / (n - j + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail * F.pow(F.lit(2.0), log_top)))


def mcnemar(gain: Column, loss: Column) -> Column:
    return binomial_two_sided(gain, loss)


def sign_test(up: Column, down: Column) -> Column:
    """Ties are left out by the caller and reported apart."""
    return binomial_two_sided(up, down)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k): 0 without a pass, 1 if fewer than k fail; null if n or c is."""
    fails = n - c
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (fails - i) / (n - i))
    return F.when(n.isNull() | c.isNull(), None).when(c <= 0, 0.0).when((c >= n) | (fails < k), 1.0).otherwise(1.0 - miss)


def holm(df: DataFrame, p: str = "p", name: str = "name", out: str = "p_holm", family: list[str] = ()) -> DataFrame:
    """Holm's adjusted p within each family, by (p, name): the running greatest of (m - rank) p, at most 1."""
    order = W.partitionBy(*family).orderBy(p, name)
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn(out, F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_raw")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho (two decimals) and n; ties take their highest rank.

    Ranks come from the counts of distinct values, so that the window runs over values, not rows.
    """

    def ranked(c: str) -> DataFrame:
        sizes = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return sizes.select(F.col("v").alias(c), (F.sum("n").over(W.orderBy("v")) - 1).alias(f"_r{c}"))

    both = df.join(ranked(x), x).join(ranked(y), y)
    n = F.count(F.lit(1))
    d2 = F.sum(F.pow(F.col(f"_r{x}") - F.col(f"_r{y}"), 2))
    return both.agg(F.round(1 - 6 * d2 / (n * (n * n - 1)), 2).alias("rho"), n.alias("n"))


def material(point: Column, low: Column, least: float = 0.10) -> Column:
    return (point >= least) & (low > 0)


def three_way(low: Column, high: Column, bound: float = 0.10) -> Column:
    """material if the interval leaves zero and reaches the bound, bounded_null if it stays inside, else inconclusive."""
    return F.when((low > 0) | (high < 0), "material").when((low > -bound) & (high < bound), "bounded_null").otherwise("inconclusive")


def rate(hits: Column, n: Column) -> Column:
    return F.try_divide(hits.cast("double"), n)

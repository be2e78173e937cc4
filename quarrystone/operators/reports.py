"""Reports over scored rows: summaries by group, agreement of two judges, draws, sign reversals, leakage, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .paired import macro_mean


def summary_by(rows: DataFrame, group: list[str], flags: list[str], digits: int = 4) -> DataFrame:
    """n, the count of every flag, and its rate rounded (0 without rows)."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(f), F.lit(False)).cast("long")).alias(f"n_{f}") for f in flags])
    return counts.select("*", *[F.round(F.coalesce(S.rate(F.col(f"n_{f}"), F.col("n")), F.lit(0.0)), digits).alias(f"{f}_rate") for f in flags])


def agreement(rows: DataFrame, simulated: str, formal: str, group: list[str] = ()) -> DataFrame:
    """How a simulated and a formal verdict (booleans, null if not definitive) agree."""
    s, f = F.col(simulated), F.col(formal)
    n = lambda c: F.sum(c.cast("long"))
    both = s.isNotNull() & f.isNotNull()
    return rows.groupBy(*group).agg(n(both & s & f).alias("agree_pass"), n(both & ~s & ~f).alias("agree_fail"), n(both & s & ~f).alias("sim_false_pass"), n(both & ~s & f).alias("sim_false_diverge"), n(~both).alias("no_formal"))


def over_draws(effects: DataFrame, draw: str, cluster: str, value: str, group: list[str] = ()) -> DataFrame:
    """Mean, least, greatest and population deviation over draws of each draw's macro effect."""
    per = macro_mean(effects, cluster, value, [*group, draw])
    return per.groupBy(*group).agg(F.avg("estimate").alias("mean"), F.min("estimate").alias("low"), F.max("estimate").alias("high"), F.stddev_pop("estimate").alias("sd"), F.count("estimate").alias("n_draws"))


def sign_reversals(contrasts: DataFrame, a: str, b: str) -> DataFrame:
    """Draws decided by both contrasts, those whose signs differ, and the shift between them."""
    decided = (F.signum(a) != 0) & (F.signum(b) != 0)
    return contrasts.agg(F.sum(decided.cast("long")).alias("decided"), F.sum((decided & (F.signum(a) != F.signum(b))).cast("long")).alias("reversed"), F.avg(F.col(b) - F.col(a)).alias("mean_shift"), F.min(F.col(b) - F.col(a)).alias("low_shift"), F.max(F.col(b) - F.col(a)).alias("high_shift"))


def share_lost(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """The effect of a full and of a reduced condition (one row each, column estimate), and the share that is lost."""
    both = full.select(F.col("estimate").alias("full")).join(F.broadcast(reduced.select(F.col("estimate").alias("reduced"))))
    return both.withColumn("lost", F.try_divide(F.col("full") - F.col("reduced"), F.col("full")))


def complete_cases(rows: DataFrame, case: str, arm: str, arms: list[str]) -> DataFrame:
    """Cases that every arm has."""
    return rows.where(F.col(arm).isin(arms)).groupBy(case).agg(F.countDistinct(arm).alias("_n")).where(F.col("_n") == len(arms)).select(case)


def lookup_either(rows: DataFrame, table: DataFrame, key: str, keys: list[str], value: str) -> DataFrame:
    """rows with value from the first of several key columns of table that holds the row's key."""
    spaces = [table.select(F.col(k).alias(key), F.lit(i).alias("_at"), F.col(value).alias("_v")).where(F.col(key).isNotNull()) for i, k in enumerate(keys)]
    every = reduce(lambda a, b: a.unionByName(b), spaces)
    first = every.groupBy(key).agg(F.min(F.struct("_at", "_v")).alias("_f"))
    return rows.join(first, key, "left").withColumn(value, F.col("_f._v")).drop("_f")


def scalar_or_mean(scalar: Column, nested: Column) -> Column:
    """The scalar, else the mean over the nested numbers without nulls; null without either."""
    kept = F.filter(nested, lambda x: x.isNotNull())
    return F.coalesce(scalar, F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)))


def lookup_k(values: Column, k: int) -> Column:
    """A map's value under the text of k."""
    return F.try_element_at(values, F.lit(str(k)))


def public_events(events: DataFrame, kinds: dict[str, list[str]], kind: str = "event", hashed: list[str] = ()) -> DataFrame:
    """Each event with the columns that its kind makes public, the hashed ones as SHA-256, others null; unknown kinds raise."""
    columns = list(dict.fromkeys(c for cs in kinds.values() for c in cs))
    known = F.when(F.col(kind).isin(list(kinds)), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), F.col(kind))))
    shown = lambda c: F.sha2(F.col(c).cast("string"), 256) if c in hashed else F.col(c)
    return events.select(known.alias(kind), *[F.when(F.col(kind).isin([k for k, cs in kinds.items() if c in cs]), shown(c)).alias(c) for c in columns])


def select_paths(paths: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Paths that some include glob and no exclude glob matches; and the globs that match nothing."""
    from ..functions.text import glob_pattern

    match = lambda globs: reduce(lambda a, b: a | b, [F.regexp_like(path, F.lit(glob_pattern(g))) for g in globs], F.lit(False))
    used = [F.max(F.regexp_like(path, F.lit(glob_pattern(g)))).alias(f"_{i}") for i, g in enumerate([*include, *exclude])]
    flags = F.array(*[F.when(~F.coalesce(F.col(f"_{i}"), F.lit(False)), F.lit(g)) for i, g in enumerate([*include, *exclude])])
    idle = paths.agg(*used).select(F.explode(F.filter(flags, lambda g: g.isNotNull())).alias("glob"))
    return paths.where(match(include) & ~match(exclude)), idle


def over_budget(counters: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Counters above their caps: name, used, cap."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("used"), F.lit(v).cast("long").alias("cap")) for k, v in caps.items()])
    return counters.select(F.explode(rows).alias("r")).select("r.*").where("used > cap")


def drop_arm(rows: DataFrame, unusable: str, most: float = 0.2) -> DataFrame:
    """dropped: whether more than the share of rows is unusable; with the share."""
    share = S.rate(F.sum(F.col(unusable).cast("long")), F.count(F.lit(1)))
    return rows.agg(share.alias("share")).withColumn("dropped", F.coalesce(F.col("share") > most, F.lit(False)))


def specialization(runs: DataFrame, expected: list[tuple[str, str]], buckets: list[str], base: tuple[str, str], tuned: tuple[str, str], contrast: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the newest run of each expected (model, signal) by bucket, and the contrast of two of them in one bucket.

    runs: model, version, signal, id, bucket, recovered.  Arms that are missing, repeated ids, other rosters or buckets
    between arms, and unknown buckets are errors.
    """
    from .gates import duplicate_keys, inconsistent_attribute, one_sided_keys, require_empty
    from .ledger import latest

    spark = runs.sparkSession
    arms = spark.createDataFrame(expected, "model string, signal string")
    slots = latest(runs.select("model", "version", "signal").distinct(), ["model", "signal"], "version")
    require_empty(one_sided_keys(slots.join(arms, ["model", "signal"], "left_semi"), arms, ["model", "signal"]), "arms are missing")
    rows = runs.join(F.broadcast(slots.join(arms, ["model", "signal"], "left_semi")), ["model", "version", "signal"], "left_semi")
    require_empty(rows.where(F.col("id").isNull() | ~F.col("bucket").isin(buckets) | F.col("recovered").isNull()), "invalid records")
    require_empty(duplicate_keys(rows, ["model", "signal", "id"]), "ids are not unique")
    require_empty(inconsistent_attribute(rows, "id", "bucket"), "buckets differ between arms")
    require_empty(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_arms")).where(F.col("n_arms") != len(expected)), "rosters differ between arms")
    counts = rows.groupBy("model", "signal", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("recovered").alias("n_recovered")).withColumn("rate", F.col("n_recovered") / F.col("n"))
    side = lambda arm: F.max(F.when((F.col("model") == arm[0]) & (F.col("signal") == arm[1]), F.col("recovered")))
    pairs = rows.where(F.col("bucket") == contrast).groupBy("id").agg(side(base).alias("a"), side(tuned).alias("b"))
    n = lambda c: F.count_if(c)
    got = pairs.agg(F.count(F.lit(1)).alias("n"), n("a").alias("base_recovered"), n("b").alias("tuned_recovered"), n(F.col("a") & ~F.col("b")).alias("base_only"), n(~F.col("a") & F.col("b")).alias("tuned_only"))
    return counts, got.withColumn("p_exact", S.mcnemar(F.col("tuned_only"), F.col("base_only")))


def marked_limit(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first rows in order, marked as a diagnostic part of a run if some are left out: the columns of rows and diagnostic."""
    if limit is None:
        return rows.withColumn("diagnostic", F.lit(False))
    more = rows.orderBy(*order).limit(limit + 1).count() > limit
    return rows.orderBy(*order).limit(limit).withColumn("diagnostic", F.lit(more))


def half_width(low: Column, high: Column) -> Column:
    """Half an interval, as it is printed behind its estimate."""
    return (high - low) / 2

"""Gates that fail closed: each returns its violations, or raises on them.

A gate is a query for the rows that break a rule; ``require_empty`` runs it and stops at the
first few.  ``guard`` puts a rule into a projection instead, so that the failing row
raises while the data stream through.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GateError(ValueError):
    pass


def require_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise GateError(f"{message}: {[r.asDict() for r in rows]}")


def guard(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df; a row for which rule is not true raises when it is read."""
    return df.withColumn("_ok", F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).where("_ok").drop("_ok")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def one_sided_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return a.join(b, keys, "full_outer").where("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_l"), "left").otherwise("right").alias("side"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that either side has more often, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def missing(subset: DataFrame, superset: DataFrame, keys: list[str]) -> DataFrame:
    return subset.select(*keys).distinct().join(superset, keys, "left_anti")


def out_of_domain(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(allowed)))


def incomplete_grid(df: DataFrame, case: str, arm: str, arms: list[str]) -> DataFrame:
    """Cases that lack an arm or have one twice."""
    cells = df.where(F.col(arm).isin(arms)).groupBy(case).agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct(arm).alias("n_arms"))
    return cells.where((F.col("n_cells") != len(arms)) | (F.col("n_arms") != len(arms)))


def inconsistent_attribute(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys with more than one value of an attribute that must be one."""
    return df.groupBy(key).agg(F.countDistinct(attribute).alias("n_values")).where("n_values > 1")


def drift(frozen: DataFrame, rebuilt: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """Rows of either side without a partner, or whose numbers differ by more than each column's tolerance."""
    a, b = frozen.alias("f"), rebuilt.alias("r")
    both = a.join(b, [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    far = [(F.abs(F.col(f"f.{c}") - F.col(f"r.{c}")) > t) | (F.col(f"f.{c}").isNull() != F.col(f"r.{c}").isNull()) for c, t in columns.items()]
    bad = far[0]
    for x in far[1:]:
        bad = bad | x
    return both.where(bad).select(*[F.coalesce(F.col(f"f.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in columns for s, n in (("f", "frozen"), ("r", "rebuilt"))])


def token_accounting(df: DataFrame, reasoning: str, output: str, budget: int) -> DataFrame:
    ok = (F.col(reasoning) >= 0) & (F.col(reasoning) <= F.col(output)) & (F.col(output) <= budget)
    return df.where(~F.coalesce(ok, F.lit(False)))


def outside(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose number is null, no number, or out of the closed range."""
    c = F.col(column)
    bad = c.isNull() | F.isnan(c.cast("double"))
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return df.where(bad)


def overlap_size(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """n_left, n_right, n_both: distinct keys of both sides and of each."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, keys, "full_outer").agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))


def calibration(records: DataFrame, expected: int, fallback_cases: list[str] = ()) -> DataFrame:
    """One row: whether a checker proves every golden pair and tells every mutant apart, each with what it rests on.

    records: case_id, comparison (golden_vs_golden or golden_vs_mutant), status, replayed, run_id, protocol, and
    qualified (whether a mutant that is not supported is told apart in another way).  Of mutants those of
    fallback_cases alone may be unsupported, and all of them must be qualified.
    """
    gold, mutant = F.col("comparison") == "golden_vs_golden", F.col("comparison") == "golden_vs_mutant"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    fallback = mutant & (F.col("status") == "UNSUPPORTED")
    got = records.agg(
        n(gold).alias("n_golden"),
        n(mutant).alias("n_mutant"),
        F.count(F.lit(1)).alias("n_rows"),
        n(gold & (F.col("status") == "PROVED")).alias("golden_proved"),
        n(mutant & (F.col("status") == "PROVED")).alias("false_proofs"),
        n(mutant & (F.col("status") == "COUNTEREXAMPLE") & F.col("replayed")).alias("replayed"),
        n(fallback).alias("n_fallback"),
        n(fallback & F.col("qualified") & F.col("case_id").isin(list(fallback_cases))).alias("fallback_told"),
        F.count_distinct(F.when(gold, F.col("case_id"))).alias("golden_cases"),
        F.count_distinct(F.when(mutant, F.col("case_id"))).alias("mutant_cases"),
        F.count_distinct("run_id").alias("n_runs"),
        F.count_distinct("protocol").alias("n_protocols"),
        n(F.col("protocol").isNull() | (F.coalesce("run_id", F.lit("")) == "")).alias("n_unbound"),
    )
    sides = records.groupBy("case_id").agg(n(gold).alias("g"), n(mutant).alias("m")).agg(F.count_if((F.col("g") > 0) != (F.col("m") > 0)).alias("n_unpaired"))
    got = got.join(F.broadcast(sides))  # one row each
    e, f = F.lit(expected), F.lit(len(fallback_cases))
    rules = [F.col("n_golden") == e, F.col("n_mutant") == e, F.col("n_rows") == 2 * e, F.col("golden_proved") == e, F.col("false_proofs") == 0, F.col("replayed") == e - f, F.col("n_fallback") == f, F.col("fallback_told") == f, F.col("golden_cases") == e, F.col("mutant_cases") == e, F.col("n_runs") == 2 * e, F.col("n_protocols") == 1, F.col("n_unbound") == 0, F.col("n_unpaired") == 0]
    return got.withColumn("passed", reduce(lambda a, b: a & b, rules))


def primary_coverage(records: DataFrame, arms: list[str], expected: int, least_definitive: int) -> DataFrame:
    """A row for each arm: records, cases, definitive verdicts, conflicts of proof and simulation, inconclusive simulations, cases that the first arm has not or has alone, and whether it passes.

    records: arm, case_id, mode, nonresearch, formal_status, replayed, simulation_status; other modes and arms are left out.
    A row without a formal or a simulated status is malformed: it is counted, and no arm passes.
    """
    rows = records.where((F.col("mode").isNull() | (F.col("mode") == "main")) & ~F.coalesce("nonresearch", F.lit(False)) & F.col("arm").isin(arms))
    bad = F.col("formal_status").isNull() | F.col("simulation_status").isNull()
    named = F.trim(F.coalesce("case_id", F.lit(""))) != ""
    n = lambda c: F.count_if(~bad & F.coalesce(c, F.lit(False)))
    formal, simulation = F.col("formal_status"), F.col("simulation_status")
    per = rows.groupBy("arm").agg(
        n(F.lit(True)).alias("n_records"),
        F.count_distinct(F.when(~bad & named, F.col("case_id"))).alias("n_cases"),
        n(~named).alias("n_unnamed"),
        n((formal == "PROVED") | ((formal == "COUNTEREXAMPLE") & F.col("replayed"))).alias("n_definitive"),
        n((formal == "PROVED") & (simulation == "COUNTEREXAMPLE")).alias("n_conflicts"),
        n(~simulation.isin("PASS", "COUNTEREXAMPLE")).alias("n_inconclusive"),
        F.count_if(bad).alias("n_malformed"),
    )
    roster = rows.where(~bad & named).select("arm", "case_id").distinct()
    first = roster.where(F.col("arm") == arms[0]).select("case_id")
    every = first.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    off = one_sided_keys(roster, every, ["arm", "case_id"]).groupBy("arm").agg(F.count(F.lit(1)).alias("n_roster"))
    spine = records.sparkSession.createDataFrame([(i, a) for i, a in enumerate(arms)], "position int, arm string")
    got = spine.join(F.broadcast(per), "arm", "left").join(off, "arm", "left").fillna(0)
    malformed = F.sum("n_malformed").over(W.partitionBy(F.lit(1)))  # a row for each arm
    ok = (F.col("n_records") == expected) & (F.col("n_cases") == expected) & (F.col("n_unnamed") == 0) & (F.col("n_roster") == 0) & (F.col("n_definitive") >= least_definitive) & (F.col("n_conflicts") == 0) & (F.col("n_inconclusive") == 0)
    return got.withColumn("passed", ok & (malformed == 0)).drop("position")


def roster_complete(rows: DataFrame, expected: DataFrame, keys: list[str]) -> None:
    """Raises unless rows have every expected key exactly once and no other."""
    require_empty(duplicate_keys(rows, keys), "repeated rows")
    require_empty(one_sided_keys(rows, expected, keys), "rows that are missing or not expected")


def digest_drift(recorded: DataFrame, actual: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Recorded keys whose digest is null, missing or another in actual: key, recorded, found."""
    a = recorded.select(key, F.col(digest).alias("recorded"))
    b = actual.groupBy(key).agg(F.max(digest).alias("found"), F.count_distinct(digest).alias("_n"))
    return a.join(b, key, "left").where("recorded IS NULL OR found IS NULL OR recorded <> found OR _n > 1").select(key, "recorded", "found")


def shared_paths(experiments: DataFrame, name: str, path: str) -> DataFrame:
    """Pairs of neighbouring experiments one of whose paths is the other's or lies below it: outer, inner."""
    rows = experiments.select(F.col(name).alias("inner"), F.concat(F.rtrim(path, F.lit("/")), F.lit("/")).alias("p")).distinct()
    depth = F.size(F.split("p", "/")) - 1
    above = rows.select("inner", "p", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(F.split("p", "/"), F.lit(1), i), "/"), F.lit("/")))).alias("q"))
    return above.join(rows.select(F.col("inner").alias("outer"), F.col("p").alias("q")), "q").where("outer <> inner").select("outer", "inner").distinct()


def leaked_identifiers(texts: DataFrame, text: str, tokens: DataFrame, token: str, keep: list[str], block: int = 100_000) -> DataFrame:
    """keep and leaked: rows of texts with each forbidden token they contain.

    An automaton over a block of tokens reads every text once; blocks are of bounded size, and a
    list of more tokens is read in several passes.
    """
    named = tokens.select(F.col(token).alias("leaked")).where("length(leaked) > 0").distinct()
    blocks = max(1, -(-named.count() // block))
    schema = texts.select(*keep).schema.add("leaked", "string")
    out = None
    for b in range(blocks):
        words = sorted(r["leaked"] for r in named.where(F.pmod(F.xxhash64("leaked"), F.lit(blocks)) == b).collect())
        shared = texts.sparkSession.sparkContext.broadcast(words)  # of at most about `block` tokens
        hits = texts.select(*keep, F.col(text).alias("_text")).mapInArrow(_contained(shared, len(keep)), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _contained(shared, width: int):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({w for _, w in automaton.iter(t)}) if t and shared.value else [] for t in batch.column(width).to_pylist()]
            rows = pa.array([i for i, ws in enumerate(found) for _ in ws], pa.int64())
            columns = [batch.column(i).take(rows) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([w for ws in found for w in ws], pa.string())], names=[*batch.schema.names[:width], "leaked"])

    return run

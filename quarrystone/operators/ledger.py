"""An append-only ledger of events: duplicate policies, responses with verdicts, outcomes, resume points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gates import duplicate_keys, require_empty

SIMULATED = ["PASS", "COUNTEREXAMPLE", "TIMEOUT", "UNSUPPORTED", "COMPILE_FAIL"]


def deduplicate(events: DataFrame, keys: list[str], order: list, policy: str) -> DataFrame:
    """One row for each key: policy 'first', 'last' or 'error' (duplicates raise)."""
    if policy == "error":
        require_empty(duplicate_keys(events, keys), "duplicate events")
        return events
    if policy not in ("first", "last"):
        raise ValueError(policy)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = [c.asc() for c in by] if policy == "first" else [c.desc() for c in by]
    return events.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*ordered))).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key."""
    return deduplicate(df, keys, list(order), "last")


def with_verdicts(responses: DataFrame, verdicts: DataFrame, key: str, override: list[str] = ()) -> DataFrame:
    """Every response with its verdict's columns.

    Of columns that both sides have, the response's value holds; of the overridden ones the verdict's, if there
    is a verdict.  Two verdicts of one key raise when they are read.
    """
    own = [c for c in verdicts.columns if c != key]
    once = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("_judged"), *[F.first(c).alias(f"_v_{c}") for c in own])
    one = F.when(F.col("_judged") > 1, F.raise_error(F.concat(F.lit("several verdicts of "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("_judged"))
    joined = responses.join(once.withColumn("_judged", one), key, "left")
    made = []
    for c in responses.columns:
        verdict_wins = c in own and c in override
        made.append(F.when(F.col("_judged") > 0, F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if verdict_wins else F.col(c))
    return joined.where("_judged IS NULL OR _judged > 0").select(*made, *[F.col(f"_v_{c}").alias(c) for c in own if c not in responses.columns])


def scoped(rows: DataFrame, mode: str | None = None, allowed: DataFrame | None = None, case: str = "case_id", research_only: bool = False) -> DataFrame:
    """Rows of a mode, of an allowlist of cases, and of research: filters that come before any validation."""
    out = rows
    if mode is not None:
        out = out.where(F.trim("mode") == mode)
    if allowed is not None:
        out = out.join(allowed.select(case).distinct(), case, "left_semi")
    if research_only:
        out = out.where(~F.coalesce("nonresearch", F.lit(False)))
    return out


def feedback_cohort(cases: DataFrame, responses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The cases whose accepted first candidate compiled and was refuted with a witness: case_id, call_id, previous_candidate, witness, in order of case.

    responses: call_id, case_id, mode, arm, model_outcome, parsed_rtl; verdicts: call_id, compiled, formal_status, witness; one row each.
    """
    first = responses.where((F.col("mode") == "main") & (F.col("arm") == "spec0_loc0") & (F.col("model_outcome") == "accepted_pending_compile"))
    first = first.withColumn("previous_candidate", F.trim(F.coalesce("parsed_rtl", F.lit("")))).where("previous_candidate <> ''")
    refuted = verdicts.where(F.coalesce("compiled", F.lit(False)) & (F.upper("formal_status") == "COUNTEREXAMPLE") & (F.length("witness") > 0))
    return first.join(refuted.select("call_id", "witness"), "call_id").join(cases.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "call_id", "previous_candidate", "witness").orderBy("case_id", "call_id")


def validation_jobs(responses: DataFrame, verdicts: DataFrame, cases: DataFrame, shift_sources: DataFrame, canonical: DataFrame) -> DataFrame:
    """A job for each accepted response without a verdict, with the source that its mode takes the golden text from.

    cases: case_id, source_case_id, validation_seed_id, source_sha256; shift_sources: source_case_id, golden_rtl, record_sha256;
    canonical: source_case_id, golden_path, golden_sha256.  A response without a case, a candidate whose digest is
    another, a source that is missing or whose digest is another: each raises when it is read.
    """
    open_ = pending(responses.where(F.col("model_outcome") == "accepted_pending_compile"), verdicts, "call_id")
    rows = open_.join(cases.select("case_id", "source_case_id", "validation_seed_id", "source_sha256"), "case_id", "left")
    rows = rows.join(shift_sources.select("source_case_id", "golden_rtl", "record_sha256"), "source_case_id", "left")
    rows = rows.join(canonical.select("source_case_id", "golden_path", F.col("golden_sha256").alias("_canonical")), "source_case_id", "left")
    shift = F.col("mode") == "shift"
    golden = F.when(shift, F.concat(F.rtrim("golden_rtl"), F.lit("\n")))
    rules = [
        (F.col("source_case_id").isNull() | F.col("validation_seed_id").isNull(), "validation mapping is missing"),
        (F.coalesce(F.col("parsed_rtl"), F.lit("")) == "", "candidate is empty"),
        (~F.col("parsed_rtl_sha256").eqNullSafe(F.sha2("parsed_rtl", 256)), "candidate SHA drift"),
        (shift & ~F.coalesce(F.col("source_sha256") == F.col("record_sha256"), F.lit(False)), "shift validation source SHA drift"),
        (shift & (F.coalesce(F.trim("golden_rtl"), F.lit("")) == ""), "shift validation golden is missing"),
        (~shift & F.col("golden_path").isNull(), "canonical main-case mapping is missing"),
    ]
    wrong = None
    for rule, message in rules:
        wrong = F.when(rule, message) if wrong is None else wrong.when(rule, message)
    rows = rows.withColumn("_wrong", wrong)
    checked = F.when(F.col("_wrong").isNotNull(), F.raise_error(F.concat_ws(" ", "_wrong", F.lit("for call"), "call_id"))).otherwise(F.col("call_id"))
    return rows.select(checked.alias("call_id"), F.col("validation_seed_id").alias("seed_id"), F.sha2("parsed_rtl", 256).alias("candidate_sha256"), golden.alias("golden_rtl"), F.when(~shift, F.col("golden_path")).alias("golden_path"), F.when(shift, F.sha2(golden, 256)).otherwise(F.col("_canonical")).alias("golden_sha256"))


def orphans(verdicts: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    return verdicts.join(responses, key, "left_anti")


def pending(jobs: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return jobs.join(completed, key, "left_anti")


def attempts(events: DataFrame, key: str, *order: str) -> DataFrame:
    """attempt_number: one more than the earlier events of the key."""
    return events.withColumn("attempt_number", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def next_attempts(jobs: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """jobs with the number of the attempt to be written before it is made: one more than the log has of the key."""
    made = log.groupBy(key).agg(F.count(F.lit(1)).alias("_made"))
    return jobs.join(made, key, "left").withColumn("attempt_number", F.coalesce("_made", F.lit(0)) + 1).drop("_made")


def outcome(outcome_col: Column, compiled: Column, formal: Column, simulation: Column, replayed: Column, inconclusive_ok: Column) -> Column:
    """struct(success, resolved, evidence, violation) of one response with its verdict; the names of evidence and statuses are fixed values.

    What contradicts itself has a violation and no success; nothing is imputed.
    """
    accepted = outcome_col == "accepted_pending_compile"
    judged = compiled.isNotNull() & formal.isNotNull() & simulation.isNotNull()
    open_formal = formal.isin("TIMEOUT", "UNSUPPORTED")
    definite = simulation.isin("PASS", "COUNTEREXAMPLE")
    violation = (
        F.when(~accepted & (compiled.isNotNull() | formal.isNotNull() | simulation.isNotNull()), "verdict_without_candidate")
        .when(~accepted, None)
        .when(~judged, "missing_validation")
        .when(~simulation.isin(SIMULATED), "unknown_simulation_status")
        .when(compiled == (formal == "COMPILE_FAIL"), "compile_formal_contradiction")
        .when(~compiled, None)
        .when((formal == "PROVED") & (simulation == "COUNTEREXAMPLE"), "proof_simulation_conflict")
        .when((formal == "COUNTEREXAMPLE") & ~F.coalesce(replayed, F.lit(False)), "counterexample_not_replayed")
        .when(open_formal & ~definite & ~F.coalesce(inconclusive_ok, F.lit(False)), "no_definitive_simulation")
        .when(~open_formal & ~formal.isin("PROVED", "COUNTEREXAMPLE"), "unknown_formal_status")
    )
    success = (
        F.when(violation.isNotNull(), None)
        .when(~accepted, False)
        .when(~compiled, False)
        .when(formal == "PROVED", True)
        .when(formal == "COUNTEREXAMPLE", False)
        .when(definite, simulation == "PASS")
    )
    evidence = (
        F.when(violation.isNotNull() | ~accepted, None)
        .when(~compiled, "compile_fail")
        .when(formal == "PROVED", "unbounded_formal_proof")
        .when(formal == "COUNTEREXAMPLE", "replayable_formal_counterexample")
        .when(definite, F.concat(F.lit("independent_simulation_fallback_after_"), F.lower(formal)))
        .otherwise("inconclusive_shift_validation")
    )
    return F.struct(success.alias("success"), (success.isNotNull() & violation.isNull()).alias("resolved"), evidence.alias("evidence"), violation.alias("violation"))


def coverage(rows: DataFrame) -> DataFrame:
    """Counts only, no effects: cases, resolved, definitive share and a map of reasons."""
    reasons = rows.where("NOT resolved").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    total = rows.agg(F.count(F.lit(1)).alias("n_cases"), F.sum(F.col("resolved").cast("long")).alias("n_resolved"))
    return total.join(F.broadcast(reasons)).withColumn("share", F.try_divide(F.col("n_resolved").cast("double"), F.col("n_cases")))


def counters(events: DataFrame) -> DataFrame:
    """Attempts, responses, retries, transport errors and verdicts of a ledger, in one pass."""
    n = lambda kind: F.sum((F.col("event") == kind).cast("long"))
    return events.agg(n("request_attempt").alias("attempts"), n("response").alias("responses"), (n("request_attempt") - F.countDistinct(F.when(F.col("event") == "request_attempt", F.col("call_id")))).alias("retries"), n("transport_error").alias("transport_errors"), n("verdict").alias("verdicts"))

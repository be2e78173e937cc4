"""Gates as rows: rules of a table, compiled into one aggregation over grouping sets.

A rule says, in SQL, what is wrong: with a row, or with a group of rows at one of a few levels (all rows, an arm, a case, a cell).
Every level is a grouping set of one pass over the table, so that many rules cost no more jobs than one; what is found is added up by
rule, with its first places.  Rosters and grids come in as rows of their own (``expected``), so a cell that is missing is a group without results,
and no join is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.deal import dealt_by_size
from .gates import GateError, require_empty


@dataclass(frozen=True)
class Rule:
    """bad: a condition of what breaks the rule, over a row's columns if level is None, else over the measures of a group of the columns level."""

    name: str
    level: tuple[str, ...] | None
    bad: str


def report(rows: DataFrame, rules: list[Rule], place: list[str], measures: dict[str, str], show: int = 3) -> DataFrame:
    """rule, n_violations, first (up to show places, as text, the least among them) and passed, for each rule.

    measures are aggregates in SQL; place names the columns that say where a row is.
    """
    levels = sorted({r.level for r in rules if r.level is not None} | {()}, key=lambda t: (len(t), t))
    columns = sorted({c for level in levels for c in level})
    # texts as measures make it an aggregation by sorting, of every row at every level: of equal parts, so that none holds what a large file does
    rows = dealt_by_size(rows, *columns)
    alone = [r for r in rules if r.level is None]
    where = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in place])
    bad = [F.coalesce(F.expr(r.bad), F.lit(False)) for r in alone]
    marked = rows.withColumn("_at", where)
    for i, b in enumerate(bad):
        marked = marked.withColumn(f"_b{i}", b)
    found = [F.count_if(F.col(f"_b{i}")).alias(f"_n{i}") for i in range(len(alone))]
    # the least places of a rule: a small array that partial aggregation keeps small
    found += [F.min(F.when(F.col(f"_b{i}"), F.col("_at"))).alias(f"_w{i}") for i in range(len(alone))]
    sets = [[F.col(c) for c in level] for level in levels]
    grouped = marked.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_level"), *[F.expr(m).alias(k) for k, m in measures.items()], *found)
    number = {level: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level) for level in levels}
    hits = []
    for r in rules:
        if r.level is None:
            i = alone.index(r)
            hits.append(F.when((F.col("_level") == number[()]) & (F.col(f"_n{i}") > 0), F.struct(F.lit(r.name).alias("rule"), F.col(f"_n{i}").alias("n"), F.col(f"_w{i}").alias("at"))))
        else:
            at = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in place if c in r.level]) if r.level else F.lit("all")
            hits.append(F.when((F.col("_level") == number[r.level]) & F.coalesce(F.expr(r.bad), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(1).cast("long").alias("n"), at.alias("at"))))
    said = grouped.select(F.explode(F.array(*hits)).alias("h")).where("h IS NOT NULL").select("h.*")
    # a few places without gathering all: the least of each class of a hash
    least = [F.min(F.when(F.pmod(F.xxhash64("at"), F.lit(show)) == i, F.col("at"))) for i in range(show)]
    total = said.groupBy("rule").agg(F.sum("n").alias("n"), F.array_sort(F.array_compact(F.array(*least))).alias("first"))
    spine = rows.sparkSession.createDataFrame([(r.name,) for r in rules], "rule string")
    got = spine.join(total, "rule", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return got.select("rule", n.alias("n_violations"), F.coalesce("first", F.array().cast("array<string>")).alias("first"), (n == 0).alias("passed"))


def check(rows: DataFrame, rules: list[Rule], place: list[str], measures: dict[str, str]) -> None:
    """Raises unless every rule holds."""
    require_empty(report(rows, rules, place, measures).where("NOT passed").orderBy("rule"), "rules are broken")


def observed(rows: DataFrame, rules: list[Rule], name: str = "rules") -> tuple[DataFrame, Observation]:
    """rows, which count what breaks the rules of single rows while another job reads them: no pass of their own."""
    watch = Observation(name)
    alone = [r for r in rules if r.level is None]
    return rows.observe(watch, *[F.count_if(F.coalesce(F.expr(r.bad), F.lit(False))).alias(r.name) for r in alone]), watch


def check_observed(watch: Observation) -> None:
    """Raises if a job that has read observed() rows met any that break a rule."""
    broken = {k: v for k, v in watch.get.items() if v}
    if broken:
        raise GateError(f"rules are broken: {broken}")


_COLUMNS = ["mode", "arm", "case_id", "seed_id", "success", "resolved", "formal_status", "simulation_status", "reason"]
_MEASURES = {
    "n": "count_if(NOT expected)",
    "n_expected": "count_if(expected)",
    "several_seeds": "min(CASE WHEN NOT expected THEN seed_id END) <> max(CASE WHEN NOT expected THEN seed_id END)",
    "n_main": "count_if(NOT expected AND mode = 'main')",
    "n_feedback": "count_if(NOT expected AND mode = 'feedback')",
}


def _listed(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _arms(names: list[str]) -> str:
    """How many of the named arms a group has results of, without a count of distinct values."""
    return " + ".join(f"max(CASE WHEN NOT expected AND arm = {_listed([n])} THEN 1 ELSE 0 END)" for n in names)


def _results(records: DataFrame) -> DataFrame:
    """The columns that rules speak of; those that records lack are null."""
    return records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("boolean" if c in ("success", "resolved") else "string").alias(c) for c in _COLUMNS], F.lit(False).alias("expected"))


def _expect(frame: DataFrame, mode: str, arms: list[str] | None = None, case: str | None = None) -> DataFrame:
    """A row for each expected case and arm, or arm, or case."""
    arm = F.explode(F.array(*[F.lit(a) for a in arms])) if arms else F.lit(None).cast("string")
    made = frame.select(F.lit(mode).alias("mode"), arm.alias("arm"), (F.col(case) if case else F.lit(None)).cast("string").alias("case_id"))
    empty = [F.lit(None).cast("boolean" if c in ("success", "resolved") else "string").alias(c) for c in _COLUMNS[3:]]
    return made.select("*", *empty, F.lit(True).alias("expected"))


def grid_report(records: DataFrame, manifest: DataFrame, arms: list[str], expected: int, mode: str = "shift") -> DataFrame:
    """Rules of a frozen grid: every case of the manifest (case_id) in each arm exactly once, nothing else, and results that say what they are.

    A result without success needs resolved = false, inconclusive statuses and a reason.
    """
    own = _results(records.where(F.col("mode") == mode))
    rows = own.unionByName(_expect(manifest.select("case_id").distinct(), mode, arms, "case_id"))
    real = "NOT expected AND "
    null = real + "success IS NULL AND "
    rules = [
        Rule("manifest size", (), f"n_expected <> {expected * len(arms)}"),
        Rule("number of results", (), f"n <> {expected * len(arms)}"),
        Rule("unexpected arm", None, f"{real}(arm IS NULL OR arm NOT IN ({_listed(arms)}))"),
        Rule("case and seed are named", None, f"{real}(coalesce(trim(case_id), '') = '' OR coalesce(trim(seed_id), '') = '')"),
        Rule("not in the manifest", ("case_id", "arm"), f"n > 0 AND n_expected = 0 AND arm IN ({_listed(arms)})"),
        Rule("missing result", ("case_id", "arm"), "n = 0 AND n_expected > 0"),
        Rule("repeated result", ("case_id", "arm"), "n > 1"),
        Rule("one seed a case", ("case_id",), "several_seeds"),
        Rule("success against resolved", None, f"{real}success IS NOT NULL AND resolved = false"),
        Rule("null success is unresolved", None, f"{null}coalesce(resolved, true)"),
        Rule("inconclusive formal status", None, f"{null}coalesce(upper(formal_status), '') NOT IN ('TIMEOUT', 'UNSUPPORTED')"),
        Rule("inconclusive simulation status", None, f"{null}coalesce(upper(simulation_status), '') NOT IN ('TIMEOUT', 'UNSUPPORTED', 'COMPILE_FAIL')"),
        Rule("reason of an inconclusive result", None, f"{null}coalesce(trim(reason), '') = ''"),
    ]
    return report(rows, rules, ["arm", "case_id"], _MEASURES)


MAIN_ARMS, FEEDBACK_ARMS = ["spec0_loc0", "spec1_loc0", "spec0_loc1", "spec1_loc1"], ["generic_failure", "concrete_counterexample"]


def coverage_report(records: DataFrame, expected: int, keep: DataFrame | None = None, main: list[str] = MAIN_ARMS, feedback: list[str] = FEEDBACK_ARMS) -> DataFrame:
    """Rules of frozen coverage: a full grid of main results, and a paired cohort of feedback results inside it with the same seeds.

    keep (case_id) is the frozen list of a clean subset: then its cases alone are looked at, and all of them must be there.
    """
    own = _results(records.where(F.col("mode").isin("main", "feedback")))
    if keep is not None:
        listed = keep.select("case_id").distinct()
        own = own.join(listed, "case_id", "left_semi").select(*_COLUMNS, "expected")
    one = records.sparkSession.range(1)
    frames = [own, _expect(one, "main", main), _expect(one, "feedback", feedback)]
    if keep is not None:
        frames.append(_expect(listed, "main", None, "case_id"))
    rows = reduce(DataFrame.unionByName, frames)
    arms = f"CASE mode WHEN 'main' THEN arm IN ({_listed(main)}) ELSE arm IN ({_listed(feedback)}) END"
    rules = [
        Rule("unexpected arm", None, f"NOT expected AND NOT coalesce({arms}, false)"),
        Rule("case and seed are named", None, "NOT expected AND (coalesce(trim(case_id), '') = '' OR coalesce(trim(seed_id), '') = '')"),
        Rule("success is true or false", None, "NOT expected AND success IS NULL"),
        Rule("repeated result", ("mode", "case_id", "arm"), "n > 1"),
        Rule("results of a main arm", ("mode", "arm"), f"mode = 'main' AND arm IN ({_listed(main)}) AND n <> {expected}"),
        Rule("results of a feedback arm", ("mode", "arm"), f"mode = 'feedback' AND arm IN ({_listed(feedback)}) AND n = 0"),
        Rule("main arms share their cases", ("mode", "case_id"), f"mode = 'main' AND n > 0 AND n_main_arms <> {len(main)}"),
        Rule("feedback arms share their cases", ("mode", "case_id"), f"mode = 'feedback' AND n > 0 AND n_feedback_arms <> {len(feedback)}"),
        Rule("one seed a case and mode", ("mode", "case_id"), "several_seeds"),
        Rule("feedback lies in main", ("case_id",), "n_feedback > 0 AND n_main = 0"),
        Rule("feedback has the seed of main", ("case_id",), "n_feedback > 0 AND n_main > 0 AND several_seeds"),
    ]
    if keep is not None:
        rules += [Rule("size of the clean subset", (), f"n_expected <> {expected + len(main) + len(feedback)}"), Rule("clean case without main results", ("mode", "case_id"), "mode = 'main' AND n_expected > 0 AND n = 0 AND case_id IS NOT NULL")]
    return report(rows, rules, ["mode", "arm", "case_id"], _MEASURES | {"n_main_arms": _arms(main), "n_feedback_arms": _arms(feedback)})

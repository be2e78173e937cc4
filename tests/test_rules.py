"""Rules in one pass: frozen grids and coverage, each broken in turn."""

import pytest

from quarrystone.operators import rules as R
from quarrystone.operators.gates import GateError

DDL = "mode string, arm string, case_id string, seed_id string, success boolean, resolved boolean, formal_status string, simulation_status string, reason string"


def grid(n=50):
    return [["shift", arm, f"x{i:02d}", f"s{i % 7}", i % 3 == 0, None, None, None, None] for arm in "ab" for i in range(n)]


def said(df):
    return {r["rule"]: (r["n_violations"], r["first"]) for r in df.collect() if not r["passed"]}


def grid_said(spark, rows, n=50):
    manifest = spark.createDataFrame([(f"x{i:02d}",) for i in range(n)], "case_id string")
    return said(R.grid_report(spark.createDataFrame(rows, DDL), manifest, ["a", "b"], 50))


def test_frozen_grid(spark):
    assert grid_said(spark, grid()) == {}
    other_mode = [["main", "zzz", "", "", None, None, None, None, None]]
    assert grid_said(spark, grid() + other_mode) == {}
    assert set(grid_said(spark, grid(), 49)) == {"manifest size", "not in the manifest"}
    assert grid_said(spark, grid()[1:]) == {"missing result": (1, ["a/x00"]), "number of results": (1, ["all"])}
    assert set(grid_said(spark, grid() + [grid()[3]])) == {"repeated result", "number of results"}
    assert grid_said(spark, [r if k else ["shift", "c", *r[2:]] for k, r in enumerate(grid())]) == {"unexpected arm": (1, ["c/x00"]), "missing result": (1, ["a/x00"])}
    blank = grid()
    blank[5][3] = " "
    assert set(grid_said(spark, blank)) == {"case and seed are named", "one seed a case"}
    seeds = grid()
    seeds[5][3] = "other"
    assert grid_said(spark, seeds) == {"one seed a case": (1, ["x05"])}


@pytest.mark.parametrize("change,want", [
    ({}, None),
    ({5: None}, "null success is unresolved"),
    ({5: True}, "null success is unresolved"),
    ({6: "PROVED"}, "inconclusive formal status"),
    ({6: None}, "inconclusive formal status"),
    ({7: "PENDING"}, "inconclusive simulation status"),
    ({7: "COMPILE_FAIL"}, None),
    ({8: "  "}, "reason of an inconclusive result"),
    ({4: True}, "success against resolved"),
])
def test_null_success_needs_its_reasons(spark, change, want):
    rows = grid()
    rows[9][4:] = [None, False, "timeout", "UNSUPPORTED", "too large"]
    for k, v in change.items():
        rows[9][k] = v
    assert list(grid_said(spark, rows)) == ([want] if want else [])


def primary(cases=85, feedback=(0, 1, 2)):
    rows = [["main", arm, f"m{i:03d}", f"s{i % 9}", True, None, None, None, None] for arm in R.MAIN_ARMS for i in range(cases)]
    return rows + [["feedback", arm, f"m{i:03d}", f"s{i % 9}", False, None, None, None, None] for arm in R.FEEDBACK_ARMS for i in feedback]


def cover(spark, rows, expected=85, keep=None):
    kept = None if keep is None else spark.createDataFrame([(f"m{i:03d}",) for i in keep], "case_id string")
    return said(R.coverage_report(spark.createDataFrame(rows, DDL), expected, kept))


def test_frozen_coverage(spark):
    assert cover(spark, primary()) == {}
    gone = [r for r in primary() if not (r[0] == "main" and r[1] == "spec1_loc1" and r[2] == "m084")]
    assert cover(spark, gone) == {"results of a main arm": (1, ["main/spec1_loc1"]), "main arms share their cases": (1, ["main/m084"])}
    unpaired = [r for r in primary() if not (r[1] == "concrete_counterexample" and r[2] == "m002")]
    assert cover(spark, unpaired) == {"feedback arms share their cases": (1, ["feedback/m002"])}
    assert cover(spark, primary(feedback=())) ["results of a feedback arm"][0] == 2
    assert set(cover(spark, primary(feedback=(0, 90)))) == {"feedback lies in main"}
    seeds = primary()
    seeds[-1][3] = "other"
    assert set(cover(spark, seeds)) == {"one seed a case and mode", "feedback has the seed of main"}
    null = primary()
    null[0][4] = None
    assert cover(spark, null) == {"success is true or false": (1, ["main/spec0_loc0/m000"])}
    assert set(cover(spark, primary() + [["main", "else", "m000", "s0", True, None, None, None, None]])) == {"unexpected arm"}
    assert set(cover(spark, [r for r in primary() if r[1] != "spec0_loc1"])) == {"results of a main arm", "main arms share their cases"}


def test_clean_subset(spark):
    rows = primary(feedback=(0, 1, 80))
    for r in rows:
        if r[0] == "main" and r[2] == "m080":
            r[4] = None
    rows.append(["shift", "spec0_loc0", "q", "s", None, None, None, None, None])
    assert cover(spark, rows, 75, range(75)) == {}
    assert "size of the clean subset" in cover(spark, rows, 75, range(74))
    assert set(cover(spark, primary(feedback=(80, 81)), 75, range(75))) == {"results of a feedback arm"}
    assert cover(spark, [r for r in rows if r[2] != "m074"], 75, range(75))["clean case without main results"] == (1, ["main/m074"])


def test_one_pass_over_the_table(spark, tmp_path):
    spark.createDataFrame(primary(80), DDL).write.parquet(str(tmp_path / "rows"))
    made = R.coverage_report(spark.read.parquet(str(tmp_path / "rows")), 85)
    assert len(made.collect()) == 11
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1


def test_rules_are_observed_while_another_job_reads(spark, tmp_path):
    rules = [R.Rule("no_negative", None, "x < 0"), R.Rule("named", None, "name IS NULL")]
    good, watch = R.observed(spark.range(50).selectExpr("id as x", "'n' as name"), rules, "good")
    good.write.parquet(str(tmp_path / "good"))
    R.check_observed(watch)
    bad, watch = R.observed(spark.range(50).selectExpr("id - 3 as x", "'n' as name"), rules, "bad")
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(GateError, match="'no_negative': 3"):
        R.check_observed(watch)
    with pytest.raises(GateError, match="broken"):
        R.check(spark.range(5).selectExpr("id - 1 as x", "'n' as name"), rules, ["name"], {"n": "count(*)"})

"""Deleted clauses and the refusals of annotations."""

import random

from pyspark.sql import functions as F

from quarrystone.functions import annotations as A


def plain(full, clause, reduced):
    """Whether some place of the clause leaves the reduced text."""
    at = full.find(clause)
    while at >= 0:
        if (full[:at] + full[at + len(clause) :]).strip() == reduced.strip():
            return True
        at = full.find(clause, at + 1)
    return False


def test_places_equal_a_search(spark):
    """Short texts of few letters and spaces: repeated clauses, clauses at the ends and with white space, wrong ones."""
    rng = random.Random(2)
    rows = []
    for _ in range(6000):
        full = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 9)))
        i = rng.randint(0, len(full))
        j = rng.randint(i, len(full))
        clause, reduced = full[i:j], full[:i] + full[j:]
        if rng.random() < 0.3:
            reduced = rng.choice([reduced.strip(), " " + reduced, reduced + "a", reduced[1:], full, ""])
        if rng.random() < 0.2:
            clause = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 3)))
        if clause:
            rows.append((full, clause, reduced))
    df = spark.createDataFrame(rows, "f string, c string, r string")
    got = df.select("f", "c", "r", A.removed_at(F.col("f"), F.col("r"), F.col("c")).alias("at")).collect()
    for r in got:
        assert (r["at"] is not None) == plain(r["f"], r["c"], r["r"]), tuple(r)
        if r["at"] is not None:
            at = r["at"]
            assert r["f"][at : at + len(r["c"])] == r["c"] and (r["f"][:at] + r["f"][at + len(r["c"]) :]).strip() == r["r"].strip(), tuple(r)


def test_each_refusal(spark):
    full = "The counter counts up. It wraps at nine. Reset is low."
    good = {"annotator_id": "x", "intent_label": "explicit", "redactable_without_hint": True, "redacted_spec": "The counter counts up. Reset is low.", "minimal_removed_clause": " It wraps at nine."}
    cases = [
        (good, None), (None, "no annotation"), (good | {"annotator_id": " "}, "annotator_id is incomplete"), (good | {"intent_label": "maybe"}, "intent_label is none of the labels"), (good | {"intent_label": None}, "intent_label is none of the labels"),
        (good | {"redactable_without_hint": None}, "redactable_without_hint is neither true nor false"), (good | {"redacted_spec": ""}, "redacted_spec is missing"),
        (good | {"intent_label": "absent"}, "absent, but a clause is removed"), (good | {"intent_label": "absent", "minimal_removed_clause": None}, "absent, but the text is changed"), (good | {"intent_label": "absent", "minimal_removed_clause": "", "redacted_spec": f" {full}\n"}, None),
        (good | {"redacted_spec": full}, "the text is not changed"), (good | {"minimal_removed_clause": " "}, "minimal_removed_clause is missing"), (good | {"minimal_removed_clause": "It wraps at nine"}, "not one exact clause is removed"),
        (good | {"redactable_without_hint": False}, "not redactable, but with a redaction"), (good | {"redactable_without_hint": False, "redacted_spec": None, "minimal_removed_clause": ""}, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, a struct<annotator_id:string,intent_label:string,redactable_without_hint:boolean,redacted_spec:string,minimal_removed_clause:string>")
    got = [r["e"] for r in df.select("i", A.annotation_error("a", F.lit(full), ["explicit", "implied", "absent"]).alias("e")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_texts_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    from quarrystone.functions import annotations as A

    plan = spark.range(1).select(A.removed_at(F.lit("a b"), F.lit("a"), F.lit("b")).alias("x"))._jdf.queryExecution().logical().toString()
    assert 0 < plan.count("regexp_replace") <= 8

"""Keyed state of a stream: restarts, conflicts, repeats, closing."""

import pytest

from quarrystone.streaming import latest as S
from quarrystone.streaming import ledger

DDL = "call string, seq long, status string, score double, at timestamp"


def put(spark, folder, rows):
    spark.createDataFrame([(c, s, st, x, None) if len(r) == 4 else r for r in rows for c, s, st, x, *_ in [r]], DDL).coalesce(1).write.mode("append").parquet(folder)


def changed(spark, folder, policy, **more):
    stream = ledger.read_events(spark, folder, DDL, files_per_trigger=1)
    return S.changes(stream, ["call"], "seq", ["status", "score"], policy, **more)


def state(spark, out):
    return {r["call"]: (r["seq"], r["status"], r["score"], r["change"]) for r in S.current(spark, out, ["call"]).collect()}


def test_the_latest_wins_over_batches_and_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, src, [("a", 1, "PASS", 1.0), ("b", 2, "FAIL", None), ("a", 3, "PASS", 1.0)])
    S.run_changes(changed(spark, src, "last"), out, ck)
    assert state(spark, out) == {"a": (1, "PASS", 1.0, 1), "b": (2, "FAIL", None, 1)}
    put(spark, src, [("a", 9, "FAIL", 0.5), ("c", 5, "PASS", 2.0)])
    put(spark, src, [("a", 4, "LATE", 0.0), ("b", 7, "PASS", 1.5), ("b", 6, "LATE", None)])
    S.run_changes(changed(spark, src, "last"), out, ck)  # a new query goes on from the checkpoint
    got = state(spark, out)
    assert got["a"] == (9, "FAIL", 0.5, 2) and got["c"] == (5, "PASS", 2.0, 1) and got["b"][1:3] == ("PASS", 1.5)
    S.run_changes(changed(spark, src, "last"), out, ck)
    assert state(spark, out) == got


def test_the_first_stays(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, src, [("a", 1, "x", 1.0), ("a", 2, "y", 2.0)])
    put(spark, src, [("a", 0, "z", 3.0)])
    S.run_changes(changed(spark, src, "first"), out, ck)
    assert len(state(spark, out)) == 1 and state(spark, out)["a"][3] == 1


def test_repeats_are_idempotent_and_conflicts_stop_the_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, src, [("a", 1, "PASS", None), ("b", 1, "PASS", 1.0)])
    put(spark, src, [("a", 2, "PASS", None)])
    S.run_changes(changed(spark, src, "error"), out, ck)
    assert {k: v[3] for k, v in state(spark, out).items()} == {"a": 1, "b": 1}
    put(spark, src, [("a", 3, "TIMEOUT", None), ("c", 3, "PASS", 1.0)])
    with pytest.raises(Exception, match="conflicting"):
        S.run_changes(changed(spark, src, "error"), out, ck)
    assert set(state(spark, out)) == {"a", "b"}  # nothing of the batch is seen


def test_idle_keys_are_closed(spark, tmp_path):
    import datetime

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = lambda *r: spark.createDataFrame(list(r), DDL).coalesce(1).write.mode("append").parquet(src)
    go = lambda: S.run_changes(changed(spark, src, "last", time="at", idle="30 minutes"), out, ck)
    rows(("a", 1, "x", 1.0, at(0)), ("b", 2, "y", 1.0, at(10)))
    rows(("b", 3, "z", 1.0, at(35)))
    go()
    rows(("c", 4, "w", 1.0, at(55)))
    rows(("d", 5, "w", 1.0, at(56)))
    go()
    assert set(state(spark, out)) == {"b", "c", "d"}  # a was silent from 0 on, b from 35
    rows(("a", 6, "again", 1.0, at(57)))
    go()
    assert state(spark, out).keys() >= {"b", "c", "d"}


def test_unknown_policy(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [("a", 1, "x", 1.0)])
    with pytest.raises(ValueError):
        changed(spark, str(tmp_path / "in"), "newest")

"""The commit log under several writers, torn writes, and its attempts."""

import threading

import pytest

from quarrystone.operators.gates import GateError
from quarrystone.sources import commits as C


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log = C.CommitLog(spark, str(tmp_path / "log"))
    numbers, errors = [], []

    def write(w):
        try:
            own = C.CommitLog(spark, str(tmp_path / "log"))
            for i in range(5):
                numbers.append(own.append(spark.createDataFrame([(w, i)], "w int, i int").coalesce(1)))
        except Exception as e:  # a thread's error is the test's
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(numbers) == list(range(1, 21)) and log.version() == 20
    rows = log.snapshot().collect()
    assert sorted((r["w"], r["i"]) for r in rows) == [(w, i) for w in range(4) for i in range(5)] and sorted(r["commit"] for r in rows) == list(range(1, 21))
    assert log.snapshot(7).count() == 7


def test_transactions_see_what_was_before_them(spark, tmp_path):
    """Three writers count attempts of one key; each sees the others' commits."""
    errors = []

    def attempt():
        try:
            for _ in range(3):
                C.record_attempts(C.CommitLog(spark, str(tmp_path / "log")), spark.createDataFrame([("k",)], "key string"), "key")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=attempt) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = C.CommitLog(spark, str(tmp_path / "log")).snapshot(kind="attempt").collect()
    assert not errors and sorted(r["attempt"] for r in got) == list(range(1, 10)) and all(r["attempt"] == r["commit"] for r in got)


def test_torn_commits_are_not_seen(spark, tmp_path):
    log = C.CommitLog(spark, str(tmp_path / "log"))
    assert log.version() == 0 and log.snapshot() is None
    log.append(spark.range(3))
    spark.range(100).write.parquet(f"{log.root}/data/0123456789abcdef0123456789abcdef")  # a writer that died before its commit
    (tmp_path / "log/commits/.half.tmp").write_text('{"version": 2, "da')
    assert log.version() == 1 and log.snapshot().count() == 3
    log.append(spark.range(2))
    assert log.version() == 2 and log.snapshot().count() == 5 and log.snapshot(1).count() == 3
    with pytest.raises(C.CommitConflict):
        log._create(2, {"version": 2})
    assert log.snapshot().count() == 5


def test_compaction_keeps_rows_and_their_numbers(spark, tmp_path):
    log = C.CommitLog(spark, str(tmp_path / "log"))
    with pytest.raises(GateError):
        log.compact()
    for n in (2, 3):
        log.append(spark.range(n))
    before = sorted((r["id"], r["commit"]) for r in log.snapshot().collect())
    assert log.compact() == 3
    log.append(spark.range(1))
    assert sorted((r["id"], r["commit"]) for r in log.snapshot().collect()) == sorted([*before, (0, 4)])
    assert log.snapshot(1).count() == 2 and log.snapshot(2).count() == 5


def test_results_need_their_attempt(spark, tmp_path):
    log = C.CommitLog(spark, str(tmp_path / "log"))
    result = lambda *rows: spark.createDataFrame(list(rows), "key string, attempt long, value string")
    with pytest.raises(GateError, match="without a committed attempt"):
        C.record_results(log, result(("a", 1, "x")), "key")
    C.record_attempts(log, spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), "key")
    C.record_results(log, result(("a", 1, "x")), "key")
    for bad, said in ((("a", 1, "y"), "have a result"), (("a", 2, "y"), "without a committed")):
        with pytest.raises(GateError, match=said):
            C.record_results(log, result(bad), "key")
    with pytest.raises(GateError, match="several results"):
        C.record_results(log, result(("b", 1, "x"), ("b", 1, "y")), "key")
    assert log.version() == 2 and log.snapshot(kind="result").count() == 1

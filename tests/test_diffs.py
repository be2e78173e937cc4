"""Diffs: longest common subsequences, round trips, targets."""

import random
import time

import pytest

from quarrystone.functions import diffs as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_matches_are_longest_and_in_order():
    rng = random.Random(3)
    for trial in range(1500):
        letters = "ab" if trial % 3 else "abcdefghij"
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 14))] for _ in "ab")
        got = D.matches(a, b)
        assert len(got) == lcs(a, b) and all(a[i] == b[k] for i, k in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_round_trips_and_targets():
    rng = random.Random(8)
    for _ in range(300):
        old = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
        new = list(old)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(new) - 1) if new else 0
            new[k : k + rng.randint(0, 2)] = [rng.choice("xyz ") for _ in range(rng.randint(0, 2))]
        a, b = "\n".join(old) + "\n", "".join(x + "\n" for x in new)
        patch = D.make(a, b, context=rng.randint(0, 3))
        if patch:
            assert D.apply(a, patch).rstrip("\n") == b.rstrip("\n")
            gone, put = D.changed(patch)
            assert all(old[n - 1] == t for n, t in gone) and all(new[n - 1] == t for n, t in put)


def test_one_line_for_one():
    old, new = "a\nb\nc\nd\ne\nf\ng\n", "a\nb\nc\nX\ne\nf\ng\n"
    assert D.target(old, D.make(old, new)) == (4, "d", 4, "X")
    moved = "new\na\nb\nc\nd\ne\n"
    for bad, said in ((D.make(old, moved), "lines"), (D.make(old, old + "h\n"), "0 lines are taken away"), ("@@ -9,1 +9,1 @@\n-x\n+y\n", "outside"), ("@@ -2,1 +2,1 @@\n-x\n+y\n", "another"), ("@@ -2,2 +2,1 @@\n-b\n+y\n", "lengths"), ("", "no hunk"), ("@@ -2,1 +2,2 @@\n-b\n+y\n+z\n", "2 lines are put in")):
        with pytest.raises(D.DiffError, match=said):
            D.target(old, bad)
    assert D.location(old, new) == (4, 4) and D.location("a\nb\n", "a\nx\ny\nb\n") is None and D.location("a\nb\nc\n", "a\n") == (2, 3) and D.location("a\n", "a\n") is None


def test_unlike_texts_are_quick():
    a, b = ([f"{s}{i}" for i in range(40_000)] for s in "ab")
    began = time.perf_counter()
    assert D.matches(a, b) == [] and D.matches(a, a[:20_000] + b[:5] + a[20_000:])[-1] == (39_999, 40_004)
    assert time.perf_counter() - began < 5


def test_columns(spark):
    rows = [("a\nb\n", "a\nc\n"), ("a\n", "a\n"), (None, "x\n"), ("", "x\n"), ("a\nb\n", "b\n")]
    df = spark.createDataFrame(rows, "o string, n string").withColumn("p", D.make_diff("o", "n"))
    got = df.select(D.diff_target("o", "p").alias("t"), D.changed_lines("o", "n").alias("c")).collect()
    assert [r["t"]["error"] for r in got] == [None, "no hunk", "no hunk", "0 lines are taken away, not one", "0 lines are put in, not one"]
    assert tuple(got[0]["t"])[:4] == (2, "b", 2, "c") and tuple(got[4]["c"]) == (1, 1)


def test_a_diff_that_is_made_and_used_at_once(spark):
    from pyspark.sql import functions as F

    rows = [("a\nb\n", "a\nc\n"), ("a\n", "a\n"), (None, "b\n"), ("a\n", None), (None, None), ("a\nb\n", "b\n"), ("", "x")] * 40
    df = spark.createDataFrame(rows, "o string, n string").coalesce(1)
    one = df.select(D.apply_made("o", "n").alias("a"), D.made_target("o", "n").alias("t")).collect()
    two = df.withColumn("p", D.make_diff("o", "n")).select(D.apply_diff("o", "p").alias("a"), D.diff_target("o", "p").alias("t")).collect()
    assert one == two and len(one) == len(rows) and spark.createDataFrame([], df.schema).select(D.apply_made("o", "n")).collect() == []


def test_few_rows_are_python_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(D.F, "arrow_udf", lambda kind: lambda run: run)
    run = D._sliced(lambda x, y: seen.append(x) or x, "string", pa.string())
    out = run(iter([(pa.array([str(i) for i in range(1000)]),) * 2]))
    assert len(next(out)) == len(seen) == D.SLICE and sum(map(len, out)) == 1000 - D.SLICE

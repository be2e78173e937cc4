"""Hash trees: equality on any partitioning, drift, locks."""

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import digests as G
from quarrystone.operators.gates import GateError

KEY, COLUMNS = ["k"], ["a", "b"]


def rows(spark, n=500):
    return spark.range(n).selectExpr("id as k", "if(id % 5 = 0, null, concat('x', id % 7)) as a", "cast(id % 3 as double) as b")


def nodes(df):
    return sorted(map(tuple, G.tree(df, KEY, COLUMNS, 2).collect()))


def test_equal_on_any_partitioning(spark):
    df = rows(spark)
    assert nodes(df) == nodes(df.repartition(7).orderBy(F.rand(1))) and nodes(df)[0][:2] == ("", 500)
    assert G.drifted(G.tree(df, KEY, COLUMNS, 2), G.tree(df.repartition(3), KEY, COLUMNS, 2)).count() == 0


def test_null_empty_and_moved_values_differ(spark):
    def one(a, b):
        df = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
        return G.tree(df, KEY, COLUMNS, 1).where("prefix = ''").first()["digest"]

    assert len({one(*x) for x in [(None, ""), ("", None), ("", ""), (None, None), ("1:", ""), (",", "x"), ("x", ","), ("1", "2"), ("12", "")]}) == 9


def test_drift_names_ranges_and_rows(spark):
    df = rows(spark)
    other = df.where("k <> 17").withColumn("b", F.when(F.col("k") == 40, 9.0).otherwise(F.col("b"))).unionByName(df.where("k = 3").withColumn("k", F.lit(9999).cast("long"))).unionByName(df.where("k = 60"))
    ranges = G.drifted(G.tree(df, KEY, COLUMNS, 2), G.tree(other, KEY, COLUMNS, 2))
    assert 1 <= ranges.count() <= 4 and {len(r["prefix"]) for r in ranges.collect()} == {2}
    got = {r["k"]: r["what"] for r in G.differing_rows(df, other, KEY, COLUMNS, ranges.select("prefix")).collect()}
    assert got == {17: "missing", 40: "changed", 9999: "extra", 60: "changed"}
    assert G.differing_rows(df, df, KEY, COLUMNS, ranges.select("prefix").limit(0)).count() == 0


def test_locks_are_written_once(spark, tmp_path):
    path = str(tmp_path / "lock")
    root = G.lock(spark, rows(spark), KEY, COLUMNS, path, 2)
    assert G.lock(spark, rows(spark).repartition(5), KEY, COLUMNS, path, 2) == root and len(root) == 64
    with pytest.raises(GateError, match="drifted in ranges"):
        G.lock(spark, rows(spark).where("k <> 3"), KEY, COLUMNS, path, 2)
    with pytest.raises(GateError, match="drifted in ranges"):
        G.lock(spark, rows(spark, 0), KEY, COLUMNS, path, 2)
    assert G.lock(spark, rows(spark), KEY, COLUMNS, path, 2) == root


def test_manifest_of_inputs(spark):
    a, b = rows(spark), rows(spark, 20)
    one = {r["name"]: r["digest"] for r in G.manifest(spark, {"a": (a, KEY, COLUMNS), "b": (b, KEY, COLUMNS)}).collect()}
    two = {r["name"]: r["digest"] for r in G.manifest(spark, {"b": (b.repartition(3), KEY, COLUMNS), "a": (a.where("k < 499"), KEY, COLUMNS)}).collect()}
    assert set(one) == {"", "a", "b"} and one["b"] == two["b"] and one["a"] != two["a"] and one[""] != two[""]

"""Many dumps in a file: the same samples as from a file each, and few files for many users."""

import random

import pytest

from quarrystone.plans import rtl_queries
from quarrystone.sources import traces as X
from tests.test_traces import dump, plain


@pytest.mark.parametrize("clock,edge,size", [("clk", "posedge", "128m"), ("clk", "negedge", "200"), (None, "posedge", "150"), ("other", "negedge", "300"), ("clk", "posedge", "90")])
def test_bundled_dumps_equal_a_plain_scan_of_each(spark, tmp_path, clock, edge, size):
    """Dumps over several splits, several dumps in a split, and splits without a dump's head."""
    rng = random.Random(11)
    texts = {f"u{i}": dump(rng, i % 9 != 0, i % 7 != 0) for i in range(60)}
    for k in range(3):
        (tmp_path / f"part{k}").write_text("".join(f"#dump {n}\n{t}" for i, (n, t) in enumerate(texts.items()) if i % 3 == k))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in X.dump_samples(X.read_dump_records(spark, str(tmp_path)), ["clk", "d"], clock, edge, bundled=True).collect():
            got.setdefault(r["dump"], []).append(r)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(texts)
    for n, t in texts.items():
        want, rows = plain(t, ["clk", "d"], clock, edge), sorted(got[n], key=lambda r: r["sample"] or 0)
        if isinstance(want, str):
            assert [r["error"] for r in rows] == [want]
        else:
            assert [(r["time"], r["values"], r["sample"]) for r in rows] == [(*w, i) for i, w in enumerate(want)] and not any(r["error"] for r in rows)


def test_files_do_not_grow_with_users(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rtl_queries, "scratch", lambda spark, name: str(tmp_path / name))
    from __spark_entry__ import queries

    got = queries()["trace_samples"](spark, "/root/testdata/sf0.01")
    assert got.select("user_id").distinct().count() > 100
    assert len(list((tmp_path / "dumps").rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))

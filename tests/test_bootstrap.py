"""The bootstrap as an aggregate against plain draws."""

import hashlib

import numpy as np
import pytest

from quarrystone.operators import bootstrap as B


def plain(means, seed, replicates):
    n = len(means)
    return [sum(means[int(hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest()[:8], 16) % n] for k in range(n)) / n for r in range(replicates)]


@pytest.mark.parametrize("block,lane", [(1 << 22, 1 << 25), (1 << 22, 100), (64, 1 << 25), (64, 500)])
def test_blocks_and_lanes_do_not_change_the_draws(spark, monkeypatch, block, lane):
    """One block or many, one lane or one a replicate, families of different sizes, a null family and a null cluster."""
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "LANE", lane)
    rng = np.random.default_rng(1)
    rows = [(f, f"c{i:04d}" if i else None, float(x)) for f, n in ((None, 3), ("a", 1), ("b", 700), ("c", 40)) for i in range(n) for x in rng.normal(0.05, 1, 2)]
    df = spark.createDataFrame(rows, "f string, c string, v double")
    got = {r["f"]: r for r in B.family_bootstrap(df, "f", "c", "v", 60, seed=5).collect()}
    assert set(got) == {None, "a", "b", "c"}
    for place, f in enumerate((None, "a", "b", "c")):
        of = {}
        for g, c, v in rows:
            if g == f:
                of.setdefault(c, []).append(v)
        means = [np.mean(of[c]) for c in sorted(of, key=lambda c: (c is not None, c))]
        est = plain(means, 5 + place, 60)
        want = np.quantile(est, [0.025, 0.975])
        p = min(1.0, 2 * min(sum(e <= 0 for e in est) + 1, sum(e >= 0 for e in est) + 1) / 61)
        assert np.allclose([got[f]["low"], got[f]["high"], got[f]["p"]], [*want, p], atol=1e-12) and got[f]["n_clusters"] == len(means)
    one = B.cluster_bootstrap(df.where("f = 'b'"), "c", "v", 60, seed=7).first()
    assert np.allclose([one["low"], one["high"]], [got["b"]["low"], got["b"]["high"]], atol=1e-12)


def test_no_row_for_each_replicate_and_cluster(spark):
    """200 replicates of 50,000 clusters: no node of the plan makes more rows than there are effects."""
    df = spark.range(50_000).selectExpr("id as c", "sin(id) as v")
    made = B.cluster_bootstrap(df, "c", "v", 200)
    assert made.collect()[0]["n_clusters"] == 50_000
    plan = made._jdf.queryExecution().executedPlan()

    def rows(node):
        out = [node.metrics().get("numOutputRows").get().value()] if node.metrics().contains("numOutputRows") else []
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        for x in [*inner, *[children.apply(i) for i in range(children.size())]]:
            out += rows(x)
        return out

    assert max(rows(plan)) <= 50_000

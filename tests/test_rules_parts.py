from quarrystone.plans.queries import QUERIES


def test_rows_are_dealt_before_they_are_grouped_at_every_level(spark):
    plan = QUERIES["frozen_grid_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RepartitionByExpression") and plan.count("RepartitionByExpression") == 2

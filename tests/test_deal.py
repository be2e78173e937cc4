import pytest

from quarrystone.functions import header as H
from quarrystone.functions import rtl as R
from quarrystone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOURCES = [
    None, "", "module m; endmodule", "module m(input a, output [3:0] q); assign a = q; endmodule",
    "module m(input clk, output reg q); always @(*) q <= clk; initial $display(1); endmodule", "module m(input a); and g(a, b); (* keep *) endmodule", "module a; module b; endmodule",
]


def test_report_reads_a_source_once(monkeypatch):
    expected = [(H.parse_module(s), R.security_reason(s), H.input_drive_reason(s)) for s in SOURCES]
    assert [H.module_report(s) for s in SOURCES] == expected
    read = []
    monkeypatch.setattr(R, "mask", lambda s, mask=R.mask: read.append(s) or mask(s))
    for s in SOURCES:
        H.module_report(s)
    assert len(read) == len(SOURCES)


@pytest.mark.parametrize("name", ["module_checks", "module_headers", "mutated_sources", "mutation_counts"])
def test_modules_are_read_by_many_tasks(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan

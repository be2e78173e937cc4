"""Module headers: what is read, and what is refused."""

import pytest

from quarrystone.functions import header as H


def ports(source):
    got = H.parse_module(source)
    return got and [(p["direction"], p["name"], p["bits"]) for p in got["ports"]]


def test_the_body_is_not_read():
    source = "module m(input a, output y); function f; input x; f = ~x; endfunction assign y = f(a); endmodule"
    assert ports(source) == [("input", "a", 1), ("output", "y", 1)] and H.input_drive_reason(source) == ""
    assert ports("module m(a, y); input a; output y; assign y = a; endmodule") is None
    assert H.input_drive_reason("module m(a, y); input a; output y; assign y = a; endmodule") == ""
    assert ports("module m; input a; endmodule") is None and ports("module m(); endmodule") is None and ports("no code") is None and ports(None) is None


@pytest.mark.parametrize("source,want", [
    ("module m #(parameter W = 8, parameter int D = $clog2(W))(input [W-1:0] a, output [D:1] y);", [("input", "a", 8), ("output", "y", 3)]),
    ("module m #(parameter [3:0] W = 4'd3, V = (W + 1) * 2)(input wire signed [V-1:0] a, b, output reg y = 0);", [("input", "a", 8), ("input", "b", 1), ("output", "y", 1)]),
    ("module m import p::*; (input logic [1:0][3:0] a, inout tri z);", [("input", "a", 8), ("inout", "z", 1)]),
    ("module m(input my_type a, input my_type [2:0] b, output y);", [("input", "a", 1), ("input", "b", 3), ("output", "y", 1)]),
    ("// module no(input x);\nmodule /* k */ m (input a /* , input b */, // input c\n output y);", [("input", "a", 1), ("output", "y", 1)]),
    ("/* module no(input x); */ module m (input a, output y); endmodule module n(input b);", [("input", "a", 1), ("output", "y", 1)]),
    ("module m(input a [3:0], output y);", None),
    ("module m(input [X:0] a, output y);", None),
    ("module m(input [N] a, output y);", None),
    ("module m(input a, output y;", None),
    ("module m #(parameter W = 8(input a, output y);", None),
    ("module m(input [((1+2)*2)-1:(0)] a,, output y);", [("input", "a", 6), ("output", "y", 1)]),
])
def test_headers(source, want):
    assert ports(source) == want


def test_clocks_resets_and_parameters():
    got = H.parse_module("module m #(parameter A = 2, parameter B = A << 3, parameter C = \"text\")(input sys_clock, CLK2, input arst_n, soft_Reset, output signed [B:0] q);")
    assert [p["name"] for p in got["ports"] if p["clock"]] == ["sys_clock", "CLK2"] and [p["name"] for p in got["ports"] if p["reset"]] == ["arst_n", "soft_Reset"]
    assert got["parameters"] == [{"name": "A", "value": 2}, {"name": "B", "value": 16}] and got["ports"][-1] == {"direction": "output", "name": "q", "width": "[B:0]", "bits": 17, "signed": True, "clock": False, "reset": False}


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("module m(input a, output y); assign a = y; endmodule",)], "s string")
    got = df.select(H.module_info("s").alias("m"), H.driven_input("s").alias("d")).collect()
    assert [r["m"] and r["m"]["name"] for r in got] == [None, None, "m"] and [bool(r["d"]) for r in got] == [False, False, True]

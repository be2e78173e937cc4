"""Queries over module sources that are made of the texts of parts: names, kinds and sizes of a part are those of its module."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import header as H
from ..functions import text as T
from ..operators.mutate import expand
from ..sources import traces
from ..sources.deal import dealt, dealt_by_size
from ..sources.scratch import scratch
from .registry import query

_when = lambda c, text: F.when(c, text).otherwise("")
_SQL_WHEN = lambda n, text: f"CASE WHEN p_size % {n} = 0 THEN '{text}' ELSE '' END"


def _module():
    """A module for each part: named by it, as wide as its size, with statements that follow its size."""
    size = F.col("p_size")
    return F.concat(
        F.lit("module "), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(" #(parameter W = "), size.cast("string"), F.lit(")(input clk, input rst_n, input [W-1:0] a, output reg [W-1:0] q);\n"),
        _when(size % 2 == 0, "wire [3:0] t;\n"), F.lit("always @(posedge clk) begin\n"), _when(size % 3 == 0, "if (!rst_n)\n"),
        F.lit("q <= 4'd"), size.cast("string"), F.lit(";\nend\n"),
        _when(size % 5 == 0, "assign t = a == q ? a : q;\n"), _when(size % 7 == 0, "sub u(.x(a));\n"), _when(size % 4 == 0, "assign t = a + q;\n"), _when(size % 6 == 0, "assign t = a && q;\n"), _when(size % 10 == 0, "assign t = a << 2;\n"),
        _when(size % 11 == 0, "initial $display(1);\n"), _when(size % 13 == 0, "assign a = q;\n"), F.lit("endmodule\n"),
    )


_SQL_MODULE = "replace('module ' || replace(p_name, ' ', '_') || '_' || p_partkey || ' #(parameter W = ' || p_size || ')(input clk, input rst_n, input [W-1:0] a, output reg [W-1:0] q);~' || " + " || ".join([
    _SQL_WHEN(2, "wire [3:0] t;~"), "'always @(posedge clk) begin~'", _SQL_WHEN(3, "if (!rst_n)~"), "'q <= 4''d' || p_size || ';~end~'", _SQL_WHEN(5, "assign t = a == q ? a : q;~"), _SQL_WHEN(7, "sub u(.x(a));~"),
    _SQL_WHEN(4, "assign t = a + q;~"), _SQL_WHEN(6, "assign t = a && q;~"), _SQL_WHEN(10, "assign t = a << 2;~"), _SQL_WHEN(11, "initial $display(1);~"), _SQL_WHEN(13, "assign a = q;~")]) + " || 'endmodule~', '~', chr(10))"
#: For each mutation a pattern of the places that it may change in these sources, and what stands there then, of the match m.
_SQL_EDITS = {
    "drop_endmodule": (r"endmodule\n", "''"),
    "delete_semicolon": (r";\n", "chr(10)"),
    "drop_one_end": (r"(?m)^end\n", "''"),
    "corrupt_pin": (r"\.x\(", "'.x_x('"),
    "width_mismatch": (r"\[W-1:0\]", "'[3:0]'"),
    "rename_declaration": (r"\bt;", "'t_undecl;'"),
    "blocking_in_seq": (r"<= 4", "'= 4'"),
    "op_swap": (r" [+] ", "' - '"),
    "flip_reset_polarity": (r"!rst_n", "'rst_n'"),
    "flip_equality": (r" == ", "' != '"),
    "swap_logical": (r" && ", "' || '"),
    "shift_swap": (r" << ", "' >> '"),
    "swap_ternary": (r"a : q", "'q : a'"),
    "off_by_one_literal": (r"4''d\d+", "'4''d' || CASE WHEN p_size = 0 THEN 1 ELSE p_size - 1 END"),
}


def _parts(table, *columns):
    """Columns of the parts, dealt before texts are made of them: reading a module costs about a millisecond, and the table has few row groups."""
    return dealt(table("part").select("p_partkey", *columns), "p_partkey")


def _expanded(table):
    return expand(_parts(table, "p_name", "p_size").select("p_partkey", _module().alias("source")), "source", ["lint", "semantic"])


@query(f"WITH s AS (SELECT {_SQL_MODULE} AS source FROM part) " + " UNION ALL ".join(f"SELECT '{k}' AS mutation, count(*) AS n FROM s WHERE regexp_matches(source, '{p}')" for k, (p, _) in _SQL_EDITS.items()))
def mutation_counts(table, spark, sf):
    """Mutations of both registries of a module made from each part, as training seeds are expanded."""
    return _expanded(table).where("broken <> source").groupBy("mutation").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS (SELECT p_partkey, p_size, {_SQL_MODULE} AS source FROM part), e AS (" + " UNION ALL ".join(f"SELECT p_partkey, p_size, source, '{k}' AS mutation, string_split_regex(source, '{p}') AS rest, regexp_extract_all(source, '{p}') AS hits, {new} AS new FROM s" for k, (p, new) in _SQL_EDITS.items()) + """),
k AS (SELECT *, ('0x' || substr(md5('0:' || mutation || ':' || source), 1, 8))::BIGINT % len(hits) AS pick FROM e WHERE len(hits) > 0),
p AS (SELECT *, list_sum(list_transform(rest[1:pick + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:pick], lambda x: length(x))), 0) AS place FROM k)
SELECT p_partkey, mutation, md5(left(source, place::BIGINT) || new || substr(source, (place + length(hits[pick + 1]) + 1)::BIGINT)) AS broken_md5 FROM p""")
def mutated_sources(table, spark, sf):
    """The changed text of every mutation of every part's module."""
    return _expanded(table).select("p_partkey", "mutation", F.md5("broken").alias("broken_md5"))


@query(rf"""WITH s AS (SELECT p_name, p_partkey, p_size, {_SQL_MODULE} AS source FROM part) SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, 4::BIGINT AS n_ports, (abs(p_size - 1) + 1)::BIGINT AS a_bits,
CASE WHEN contains(source, '$display') THEN 'candidate security preflight rejected system task/function $display' ELSE '' END AS refused, CASE WHEN contains(source, 'assign a =') THEN 'candidate security preflight rejected drive of input port' ELSE '' END AS driven,
len(regexp_extract_all(source, '\bbegin\b')) = len(regexp_extract_all(source, '\bend\b')) AS balanced FROM s""")
def module_checks(table, spark, sf):
    seeds = _parts(table, "p_name", "p_size").select(_module().alias("source")).withColumn("report", H.module_reports("source"))
    read = seeds.withColumn("info", H.info_of(F.col("report")))
    return read.select("info.name", F.size("info.ports").cast("long").alias("n_ports"), F.col("info.ports")[2]["bits"].alias("a_bits"), "report.refused", "report.driven", T.brackets_balanced("source").alias("balanced"))


def _port_words():
    """Names of ports: the words of a part's name, its kind and its brand, in lower case."""
    return F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", "_"))), " ")


@query(r"""WITH w AS (SELECT *, string_split(lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '_')), ' ') AS w FROM part)
SELECT p_partkey, CASE WHEN ok THEN 'top_' || w[1] END AS name, CASE WHEN ok THEN array_to_string(['input ' || w[1] || '_clk 1', 'input ' || w[2] || ' ' || (p_size + 1)] || CASE WHEN p_size % 3 = 0 THEN ['input ' || w[2] || '_n 1'] ELSE [] END || ['output ' || w[3] || ' ' || (p_size * (p_size % 4 + 1)), 'inout ' || w[4] || ' 1'], ', ') END AS ports,
CASE WHEN ok THEN 'W=' || p_size || ',D=' || (p_size % 4 + 1) END AS parameters
FROM (SELECT *, p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0 AS ok FROM w)""")
def module_headers(table, spark, sf):
    """Headers with parameters, packed and nested ranges, attributes of nets, comments, functions and tasks behind them; and such as can't be driven.

    Of sizes that 7 divides directions stand in the body, of 11 a port is an unpacked array, of 13 a width is no constant.
    """
    w, size = _port_words(), F.col("p_size")
    at = lambda i: F.element_at(w, i)
    text = size.cast("string")
    ansi = F.concat(
        F.lit("// module not(this);\nmodule top_"), at(1), F.lit(" #(parameter int W = "), text, F.lit(", parameter D = W % 4 + 1) (\n  input wire "), at(1), F.lit("_clk, /* , input no */ input logic [W:0] "), at(2),
        _when(size % 3 == 0, ", "), F.when(size % 3 == 0, F.concat(at(2), F.lit("_n"))).otherwise(""),
        F.lit(",\n  output reg signed ["), F.when(size % 13 == 0, "X").otherwise("W*(D)-1"), F.lit(":(0)] "), at(3), _when(size % 11 == 0, " [0:3]"), F.lit(",\n  inout "), at(4), F.lit(");\n"),
        F.lit("function f; input x; f = ~x; endfunction\ntask t(input [7:0] z, output y); y = z[0]; endtask\nendmodule\n"),
    )
    old = F.concat(F.lit("module top_"), at(1), F.lit("("), at(2), F.lit(", "), at(3), F.lit(");\ninput "), at(2), F.lit(";\noutput "), at(3), F.lit(";\nendmodule\n"))
    got = _parts(table, "p_name", "p_type", "p_brand", "p_size").select("p_partkey", H.module_info(F.when(size % 7 == 0, old).otherwise(ansi)).alias("m"))
    port = F.transform("m.ports", lambda p: F.concat_ws(" ", p["direction"], p["name"], p["bits"].cast("string")))
    parameter = F.transform("m.parameters", lambda p: F.concat_ws("=", p["name"], p["value"].cast("string")))
    return got.select("p_partkey", "m.name", F.when(F.col("m").isNotNull(), F.array_join(port, ", ")).alias("ports"), F.when(F.col("m").isNotNull(), F.array_join(parameter, ",")).alias("parameters"))


_DECLARED = ["$scope module top $end", "$scope module uut $end", "$var wire 1 i clk $end", "$var wire 8 j d [7:0] $end", "$upscope $end", "$var wire 1 ! clk $end", "$var wire 8 v d [7:0] $end", "$upscope $end", "$enddefinitions $end"]


@query("""WITH s AS (SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'view' THEN event_id % 2 END IGNORE NULLS) OVER w AS clk, last_value(CASE WHEN event_type = 'click' THEN bin(floor(value)::BIGINT) END IGNORE NULLS) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, coalesce(lag(clk) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 0 AND clk = 1 AS edge FROM s WHERE clk IS NOT NULL AND d IS NOT NULL),
k AS (SELECT * FROM p QUALIFY edge OR NOT bool_or(edge) OVER (PARTITION BY user_id))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER - 1 AS sample, event_id AS time, clk::VARCHAR AS clk, d, NULL::VARCHAR AS error FROM k
UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL, NULL, 'no complete sample' FROM s WHERE user_id NOT IN (SELECT user_id FROM p)""")
def trace_samples(table, spark, sf):
    """A change dump of each user's events, with two signals of each name, written into files of many dumps, and its samples at clock edges."""
    root = scratch(spark, "dumps")
    events = table("events")
    name = F.coalesce(F.col("user_id").cast("string"), F.lit("none"))
    heads = events.select("user_id").distinct().select("user_id", F.lit(0).alias("line"), F.lit(None).cast("long").alias("event_id"), F.concat(F.lit("#dump "), name, F.lit("\n" + "\n".join(_DECLARED))).alias("value"))
    lines = [
        F.concat(F.lit("#"), F.col("event_id").cast("string")),
        F.when(F.col("event_type") != "view", F.concat((F.col("event_id") % 2).cast("string"), F.lit("!"))),
        F.when(F.col("event_type") == "click", F.concat(F.lit("b"), F.bin(F.floor("value").cast("long")), F.lit(" v"))),
        F.lit("xi"), F.lit("b11 j"), F.lit("r0.5 r"),
    ]
    body = events.select("user_id", F.lit(1).alias("line"), "event_id", F.concat_ws("\n", *lines).alias("value"))
    # a file for each part, not for each user: the rows of a user come to one task, and are sorted there, not held
    parts = dealt_by_size(heads.unionByName(body), "user_id").sortWithinPartitions("user_id", "line", "event_id")
    parts.select("value").write.text(root)
    got = traces.dump_samples(traces.read_dump_records(spark, root), ["clk", "d"], "clk", bundled=True)
    return got.select(F.nullif("dump", F.lit("none")).cast("long").alias("user_id"), F.col("sample"), "time", F.element_at("values", "clk").alias("clk"), F.element_at("values", "d").alias("d"), "error")

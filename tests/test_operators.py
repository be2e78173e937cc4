"""Small exact vectors for functions, operators, sources, sinks and streams."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import diffs
from quarrystone.functions import header as H
from quarrystone.functions import rtl as R
from quarrystone.functions import stats as S
from quarrystone.functions import text as T
from quarrystone.operators import datagen as D
from quarrystone.operators import gates as G
from quarrystone.operators import ledger as L
from quarrystone.operators import mutate as M
from quarrystone.operators import paired as P
from quarrystone.operators.sampling import quota_sample
from quarrystone.sources import readers, sinks
from quarrystone.streaming import ledger as SL

MODULE = """// a counter
module cnt #(parameter W = 4)(input clk, input rst_n, input [W-1:0] d, output reg [3:0] q);
  wire [3:0] t;
  assign t = q + 4'd1; /* module fake */
  always @(posedge clk) begin
    if (!rst_n)
      q <= 4'd0;
    else
      q <= (d == t) ? a : b;
  end
  sub u(.clk(clk));
endmodule
"""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_macro_mean_weighs_clusters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", -1.0)], "c string, v double")
    r = P.macro_mean(df, "c", "v").first()
    assert (r["estimate"], r["n_clusters"], r["n_cases"]) == (0.0, 2, 3)


def test_holm_and_materiality(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: round(r["p_holm"], 9) for r in S.holm(df).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    rows = spark.createDataFrame([(0.10, 0.01), (0.09, 0.01), (0.20, 0.0)], "p double, low double")
    assert [r[0] for r in rows.select(S.material(F.col("p"), F.col("low"))).collect()] == [True, False, False]
    verdicts = spark.createDataFrame([(0.02, 0.3), (-0.05, 0.05), (-0.2, 0.3)], "l double, h double")
    assert [r[0] for r in verdicts.select(S.three_way(F.col("l"), F.col("h"))).collect()] == ["material", "bounded_null", "inconclusive"]


def test_exact_tests_at_all_sizes(spark):
    pairs = [(0, 0), (13, 40), (22, 4), (58, 21), (5, 5), (300, 159), (0, 30), (1, 0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(S.mcnemar(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(pairs, got, strict=True):
        n, k = a + b, min(a, b)
        want = min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n) if n else 1.0
        assert math.isclose(p, want, rel_tol=1e-9)


def test_wilson_pass_at_k_spearman(spark):
    r = spark.createDataFrame([(353, 374), (0, 0), (23, 85)], "k int, n int").select(S.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert [(round(100 * x["w"]["low"], 1), round(100 * x["w"]["high"], 1)) for x in r] == [(91.6, 96.3), (0.0, 0.0), (18.8, 37.3)]
    cases = [(5, 0), (5, 2), (5, 5), (3, 2), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(cases, "n int, c int").select(S.pass_at_k(F.col("n"), F.col("c"), 2)).collect()]
    assert got[0] == 0 and math.isclose(got[1], 1 - 3 / 10) and got[2] == 1 and got[3] == 1 and got[4] is None
    df = spark.createDataFrame([(1, 10), (2, 20), (2, 15), (4, 40)], "x int, y int")
    assert S.spearman(df, "x", "y").first()["rho"] == round(1 - 6 * 1 / (4 * 15), 2)


def test_pivot_policies_and_interaction(spark):
    rows = [("c1", "s", a, v) for a, v in (("00", 0.0), ("01", 1.0), ("10", 1.0), ("11", 1.0))] + [("c2", "s", "00", None), ("c2", "s", "01", 1.0)]
    df = spark.createDataFrame(rows, "case string, seed string, arm string, v double")
    grid = P.pivot_arms(df, "case", "seed", "arm", "v", ["00", "01", "10", "11"], "intersection")
    assert [r[0] for r in grid.select(P.difference_in_differences("00", "01", "10", "11")).collect()] == [-1.0]
    with pytest.raises(G.GateError):
        P.pivot_arms(df, "case", "seed", "arm", "v", ["00", "01", "10", "11"])
    assert P.pivot_arms(df, "case", "seed", "arm", "v", ["00", "01"], "intersection").count() == 2
    assert P.pivot_arms(df, "case", "seed", "arm", "v", ["00", "01"], "definitive").count() == 1


def test_bootstrap_is_the_same_on_any_partitioning_and_near_python(spark):
    rng = random.Random(1)
    rows = [(f"s{i % 17}", rng.random() - 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, e double")
    a, b = (P.cluster_bootstrap(x, "c", "e", 1000).first() for x in (df, df.repartition(7)))
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))
    i, p = P.cluster_bootstrap(df, "c", "e", 1000, interval="index", add_one=False).first(), P.python_bootstrap(df, "c", "e", 1000).first()
    assert abs(a["low"] - p["low"]) < 0.02 and abs(a["high"] - p["high"]) < 0.02 and abs(i["low"] - a["low"]) < 0.01
    assert math.isclose(a["estimate"], p["estimate"], rel_tol=1e-9)


def test_extraction(spark):
    text = f"Here:\n```verilog\n{MODULE}```\nand\n```\nmodule other; endmodule\n```"
    assert one(spark, T.extract_rtl("t", F.lit("other")), t=text) == "module other; endmodule"
    assert one(spark, T.extract_rtl("t"), t="no code") == "no code"
    assert one(spark, T.extract_answer("t"), t="<think>```verilog\nmodule x; endmodule```</think><answer>module y; endmodule") == "module y; endmodule\n"
    assert one(spark, T.extract_answer("t"), t="<think>module x; endmodule</think>none") is None
    assert one(spark, T.complete_modules("t"), t="module a; endmodule text module b; endmodule module c;") == "module a; endmodule\n\nmodule b; endmodule"
    assert one(spark, T.extract_code_block("t"), t="```\na\n```x```SV \nmodule b;\n```") == "module b;"
    assert one(spark, T.extract_code_block("t"), t="```py\na\n```\n") is None and one(spark, T.extract_code_block("t"), t="```\nmodule c\n```") == "module c"
    assert one(spark, T.extract_header("t"), t="module a (x); body module b (y); z);") == "module b (y);"
    assert one(spark, T.extract_header("t"), t="module a (x); and a module without one") is None
    assert one(spark, T.module_families("t"), t="module Top; endmodule module FIFO_x; endmodule") == ["fifo_x"]
    assert one(spark, T.taxonomy("t"), t=MODULE).asDict() == {"code_lines": 11, "sequential": True, "has_case": False, "has_state": False}
    assert one(spark, T.first_new_line("b", "g"), b="a\nx = 1;\nb", g="a\n  b") == "x = 1;"
    body, cut = T.trim_edge_lines("t")
    assert one(spark, F.struct(body.alias("b"), cut.alias("c")), t="\n \na\n\nb\n\n").asDict() == {"b": "a\n\nb", "c": 2}


def test_normalising_order_and_hashes(spark):
    assert one(spark, T.normalize_rtl("t"), t="A  // x\n/* c\n */ B") == "a b"
    assert one(spark, T.normalize_rtl("t"), t="a /* // */ b") == "a /*"  # the line comment goes first, with the block's end
    assert one(spark, T.dedup_hash("t"), t="A  b // c") == hashlib.md5(b"A b").hexdigest()
    assert one(spark, T.digest(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\0b").hexdigest()[:24]


def test_redaction_and_scan(spark):
    text = "mail me.x@a-b.org, Bearer abcdefghijklmnop, sk-abcdefghijklmnopqrst at /home/joe/x and git@host:a/b.git case_7 by Ann"
    got = one(spark, T.sanitize("t", [("case_7", "C1")], ["ann"]), t=text)
    assert got == "mail [REDACTED_EMAIL], [REDACTED_CREDENTIAL], [REDACTED_CREDENTIAL] at <LOCAL_PATH> and [REDACTED_GIT_REMOTE] C1 by [ANONYMIZED]"
    assert one(spark, T.findings("t"), t="at 10.1.2.3 and 127.0.0.1") == ["literal IPv4 endpoint"]
    assert one(spark, T.findings("t"), t="127.0.0.1") == []
    for glob, path, want in (("a/**/b.py", "a/x/y/b.py", True), ("a/*.py", "a/x/b.py", False), ("**/*.md", "c.md", True), ("a?.t", "ab.t", True)):
        assert one(spark, F.regexp_like("p", F.lit(T.glob_pattern(glob))), p=path) is want


def test_rtl_functions():
    masked = R.mask('a // "x\nb "s//t" /* c\nd */ e')
    assert masked.split() == ["a", "b", "e"] and len(masked) == len('a // "x\nb "s//t" /* c\nd */ e') and masked.count("\n") == 2
    assert R.security_reason(MODULE) == ""
    refused = lambda new, old="assign": R.security_reason(MODULE.replace(old, new)).removeprefix(R.REFUSED)
    assert "exactly one module" in R.security_reason(MODULE + MODULE)
    assert refused("`define X\nassign") == "preprocessor directive" and refused("$display(1); assign") == "system task/function $display"
    assert refused("assign x = u.secret; assign") == "hierarchical or cross-scope reference" and refused("property p; endproperty assign").startswith("embedded verification")
    assert R.security_reason(MODULE.replace("always @(posedge clk)", "always @(*)")) == ""
    assert refused("(* keep *) wire", "wire") == "source attribute" and R.security_reason(MODULE, ("u",)) == R.REFUSED + "reserved verifier hierarchy"
    drives = lambda new, old="assign t =": H.input_drive_reason(MODULE.replace(old, new)).removeprefix(R.REFUSED)
    assert H.input_drive_reason(MODULE) == "" and H.input_drive_reason("") == "" and drives("assign d =") == "drive of input port"
    assert drives("assign {d, q} =") == drives("always @* d++; assign t =") == drives("always @* {t, {d[1], q}} <= 2; assign t =") == drives("always @* case (q) 1: d <= q; endcase assign t =") == "drive of input port"
    assert drives("buf(d, q); assign t =") == "primitive drive of input port" and drives("assign t = d <= 3 ? d : d <= 2; assign q =") == ""
    assert H.parse_module("module m #(parameter W = 8)(input [W-1:0] a, output [$clog2(W)-1:0] b); endmodule")["ports"][1]["bits"] == 3
    assert [p["name"] for p in H.parse_module(MODULE)["ports"]] == ["clk", "rst_n", "d", "q"]
    assert R.canonical_json('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and R.canonical_json("x") is None


def test_diffs():
    rng = random.Random(0)
    for _ in range(60):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        new = [x for x in old if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        a, b = "\n".join(old) + "\n", "\n".join(new) + "\n"
        patch = diffs.make(a, b)
        if patch:
            assert diffs.apply(a, patch).rstrip("\n") == b.rstrip("\n")
    with pytest.raises(diffs.DiffError):
        diffs.apply("a\nb\n", "@@ -1,1 +1,1 @@\n-x\n+y\n")
    with pytest.raises(diffs.DiffError):
        diffs.apply("a\n", "@@ -1,2 +1,1 @@\n-a\n+y\n")
    with pytest.raises(diffs.DiffError):
        diffs.apply("a\n", "nothing")
    assert diffs.location("a\nb\nc\n", "a\nx\nc\n") == (2, 2) and diffs.location("a\nb\nc\n", "x\nb\ny\n") is None


def test_mutations(spark):
    names = [n for r in ("lint", "semantic") for n in M.REGISTRIES[r] if M.mutate(MODULE, r, n, 0)]
    assert names == ["drop_endmodule", "delete_semicolon", "drop_one_end", "corrupt_pin", "width_mismatch", "rename_declaration", "blocking_in_seq", "op_swap", "flip_reset_polarity", "flip_equality", "swap_ternary", "off_by_one_literal"]
    assert "endmodule" not in M.mutate(MODULE, "lint", "drop_endmodule", 0) and "if (rst_n)" in M.mutate(MODULE, "semantic", "flip_reset_polarity", 0)
    assert M.mutate("q <= a ? b[1] : 4'd2;", "semantic", "swap_ternary", 0) == "q <= a ? 4'd2 : b[1];"
    assert all(M.mutate("x = 4'hz + 4'd0;", "semantic", "off_by_one_literal", i) == "x = 4'hz + 4'd1;" for i in range(6))
    assert M.mutate("// a + b\n", "semantic", "op_swap", 0) is None and M.mutate("a = b + c; // d & e", "semantic", "op_swap", 1) == "a = b - c; // d & e"
    seeds = spark.createDataFrame([("a", MODULE), ("b", "nothing"), ("c", None)], "seed_id string, source string")
    got = M.expand(seeds, "source", "lint", 3).collect()
    assert {r["seed_id"] for r in got} == {"a"} and len(got) == 7


def test_ledger_policies_and_gates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    pick = lambda p: sorted(r["v"] for r in L.deduplicate(df, ["k"], ["t"], p).collect())
    assert pick("first") == ["a", "c"] and pick("last") == ["b", "c"]
    with pytest.raises(G.GateError):
        L.deduplicate(df, ["k"], ["t"], "error")
    other = spark.createDataFrame([(2, None)], "k int, v string")
    assert {(r["k"], r["v"]) for r in L.with_verdicts(df.where("t = 1"), other, "k", ["v"]).collect()} == {(1, "a"), (2, None)}
    assert {(r["k"], r["v"]) for r in L.with_verdicts(df.where("t = 1"), other, "k").collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(Exception, match="several verdicts"):
        L.with_verdicts(df, df, "k").collect()
    with pytest.raises(Exception, match="bad row"):
        G.guard(df, F.col("t") < 2, "bad row").collect()
    assert G.out_of_domain(df, "v", ["a", "b"]).count() == 1
    tokens = spark.createDataFrame([(1, 2), (3, 2), (2, 9)], "r int, o int")
    assert G.token_accounting(tokens, "r", "o", 5).count() == 2
    rows = spark.createDataFrame([(True, None), (False, "x"), (False, "x")], "resolved boolean, reason string")
    r = L.coverage(rows).first()
    assert (r["n_cases"], r["n_resolved"], r["reason_counts"]) == (3, 1, {"x": 2})


def test_datagen(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)], "i int, g string")
    assert D.cap_per_group(df, ["g"], ["i"], 0).count() == 30 and D.cap_per_group(df, ["g"], ["i"], 4).count() == 12
    assert sorted(r["record_id"] for r in D.record_ids(df, "r_", ["i"]).collect()) == [f"r_{i:04d}" for i in range(30)]
    records = spark.createDataFrame([(1, ["a"]), (2, ["b", None])], "id int, fp array<string>")
    held = spark.createDataFrame([(["b"],)], "fp array<string>")
    reasons = D.fingerprint_reasons(records, held, "id", {"hash": "fp"})
    assert [(r["id"], r["reasons"]) for r in reasons.collect()] == [(2, ["hash"])]
    with pytest.raises(ValueError, match="no usable"):
        D.fingerprint_reasons(records, held.limit(0), "id", {"hash": "fp"})
    m = one(spark, D.messages(("system", F.lit(None).cast("string")), ("user", F.lit("q")), ("assistant", F.lit("a"))))
    assert [tuple(x) for x in m] == [("user", "q"), ("assistant", "a")]


def test_quota_sample_equals_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(60)}", i, rng.choice("ab"), rng.choice("xy")) for i in range(150)]
    quotas = {("a", "x"): 12, ("a", "y"): 3, ("b", "x"): 20, ("b", "y"): 0}
    order = lambda *k: hashlib.sha256("\0".join(["quarrystone-order-9", *map(str, k)]).encode()).hexdigest()
    supply = {q: len({t for t, _, *s in rows if tuple(s) == q}) for q in quotas}
    taken, want = set(), set()
    for q in sorted((q for q in quotas if quotas[q]), key=lambda q: (supply[q] / quotas[q], supply[q], q)):
        slot = 0
        for stage, fits in (("requested_stratum", lambda s: s == q), ("same_first_other_second", lambda s: s[0] == q[0] and s != q), ("global_remaining", lambda s: True)):
            pool = {}
            for t, i, *s in rows:
                if t not in taken and fits(tuple(s)):
                    pool.setdefault(t, []).append(i)
            for t in sorted(pool, key=lambda t: (order(t), t))[: quotas[q] - slot]:
                taken.add(t)
                want.add((t, min(pool[t], key=order), list(quotas).index(q), stage, slot))
                slot += 1
    got = quota_sample(spark.createDataFrame(rows, "task string, record long, p string, q string"), "task", "record", ["p", "q"], quotas, 9).collect()
    assert {tuple(r) for r in got} == want


def test_quota_sample_is_unique_and_falls_back(spark):
    rows = [(f"t{i}", f"r{i}{s}", s, "seq" if i % 5 == 0 else "comb") for i in range(40) for s in ("base", "adapter") if s == "base" or i < 12]
    df = spark.createDataFrame(rows, "task string, record string, source string, timing string")
    quotas = {("base", "comb"): 10, ("base", "seq"): 4, ("adapter", "comb"): 5, ("adapter", "seq"): 5}
    got = quota_sample(df, "task", "record", ["source", "timing"], quotas).collect()
    again = quota_sample(df.repartition(5), "task", "record", ["source", "timing"], quotas).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len({r["task"] for r in got}) == len(got) == 24
    assert {r["stage"] for r in got if r["stratum_no"] == 3} == {"requested_stratum", "same_first_other_second"}
    with pytest.raises(ValueError, match="could not fill"):
        quota_sample(df, "task", "record", ["source", "timing"], {("base", "comb"): 100})


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert readers.read_jsonl(spark, str(p), "id string, n int").count() == 2
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "x", "n": 1}\nplain\n"quoted"\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), "id string, n int").collect()
    assert readers.read_jsonl(spark, str(bad), "id string, n int", "skip").count() == 1
    assert [r["id"] for r in readers.read_jsonl(spark, str(bad), "", "tolerant").collect()] == ["x", "plain", "quoted"]
    torn = tmp_path / "torn.log"
    torn.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert readers.whole_lines(spark, str(torn)).count() == 2
    for name, value in (("o", {"m": 1}), ("l", [{"m": 2}, {"m": 3}]), ("r", {"rows": [{"m": 4}]}), ("x", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value) if value is not None else "broken")
    docs = readers.read_documents(spark, [str(tmp_path / f"{n}.json") for n in "olrx"], "m int")
    assert sorted(r["m"] for r in docs.collect() if r["m"] is not None) == [1, 2, 3, 4]
    corpus = tmp_path / "corpus" / "sub"
    corpus.mkdir(parents=True)
    (corpus / "m1.sv").write_text("module\nm1")
    assert [tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "corpus"), "*.sv", True, "t").collect()] == [("m1", "module\nm1", "t")]
    assert readers.read_binary_digests(spark, str(tmp_path / "corpus")).first()["sha256"] == hashlib.sha256(b"module\nm1").hexdigest()
    tex = tmp_path / "t.tex"
    tex.write_text("\\toprule\ngpt & 1.5 & 2.0 \\\\\nother & 3.5 & 4.0 \\\\\n")
    assert [tuple(r) for r in readers.latex_rows(spark, str(tex), r"^(\w+) & ([\d.]+) &", ["m", "v"]).collect()] == [("gpt", "1.5"), ("other", "3.5")]
    trace = "Hint: Output 'q' has 3 mismatches. First mismatch occurred at time 40.\nMismatches: 3 in 100 samples"
    assert one(spark, readers.parse_trace("t"), t=trace).asDict() == {"output": "q", "mismatches": 3, "samples": 100, "first_mismatch_time": 40}
    nested = spark.createDataFrame([([("", "b", 1), ("a", "c", 2)],)], "cases array<struct<p:string,q:string,v:int>>")
    assert [r["overlay_id"] for r in readers.overlay(nested, "cases", ["p", "q"]).collect()] == ["b", "a"]

    df = spark.createDataFrame([("m", "20240101-a", "s", 1), ("m", "20240102-b", "s", 2)], "model string, version string, signal string, n int")
    out = str(tmp_path / "out")
    sinks.write_jsonl(df, out)
    assert spark.read.json(out).count() == 2
    with pytest.raises(FileExistsError):
        sinks.write_jsonl(df, out)
    sinks.write_jsonl(df.limit(1), out, overwrite=True)
    assert spark.read.json(out).count() == 1
    root = str(tmp_path / "runs")
    sinks.put_run(df, root)
    with pytest.raises(FileExistsError):
        sinks.put_run(df, root)
    runs = spark.read.parquet(root)
    assert [r["n"] for r in sinks.newest_runs(runs).collect()] == [2] and sinks.run_index(runs).count() == 2
    sinks.write_document(spark, {"b": 1, "a": [2]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": [2], "b": 1}
    assert sinks.markdown_table(spark.createDataFrame([("x", 0.5), ("y", None)], "a string, b double")).splitlines()[2:] == ["| x | 0.500 |", "| y | - |"]
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.append(df, out)
    assert spark.read.json(out).count() == 3


def test_stream_ingest_matching_and_windows(spark, tmp_path):
    schema = "call_id string, ts timestamp, v int"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, "call_id string, t string, v int").selectExpr("call_id", "timestamp(t) AS ts", "v").coalesce(1).write.mode("append").parquet(src)
    write([("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:10:00", 2)])
    run = lambda: SL.ingest(SL.read_events(spark, src, schema), out, str(tmp_path / "cp"), "call_id", ["v"]).awaitTermination()
    run()
    write([("a", "2024-01-01 00:00:00", 1), ("c", "2024-01-01 01:00:00", 3)])  # a again, unchanged
    run()
    assert sorted(r["call_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    write([("a", "2024-01-01 00:00:00", 9)])
    with pytest.raises(Exception, match="conflicting"):
        run()

    def drain(df, mode):
        name = f"t{random.randrange(10**9)}"
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    late = str(tmp_path / "verdicts")
    spark.createDataFrame([("a", "2024-01-01 00:20:00", 1), ("z", "2024-01-02 12:00:00", 1)], "call_id string, t string, v int").selectExpr("call_id", "timestamp(t) AS ts", "v").write.parquet(late)
    got = drain(SL.matched(SL.read_events(spark, src, schema).where("v < 9"), SL.read_events(spark, late, schema), "call_id", "ts"), "append")
    assert any(r[0] == "a" and r[3] == "a" for r in got)
    wins = drain(SL.windowed(SL.read_events(spark, src, schema), "ts", "30 minutes", [], "v"), "complete")
    assert sum(r["n"] for r in wins) == 5 and len(wins) == 2
    once = drain(SL.once_each(SL.read_events(spark, src, schema), ["call_id"], "ts", "1 day"), "append")
    assert sorted(r["call_id"] for r in once) == ["a", "b", "c"]


def test_prompts_and_small_functions(spark):
    from quarrystone.functions import prompts as Pr
    from quarrystone.operators import reports as Rp

    assert one(spark, Pr.block_after("t", "Broken RTL"), t="x\nBroken RTL (a.sv):\n```verilog\nmodule m;\n```\nend") == "module m;\n"
    assert one(spark, Pr.block_after("t", "Other"), t="none") is None
    assert one(spark, Pr.explanation_and_code("t"), t="why\n```\na\n```\n```sv\nb\n```").asDict() == {"explanation": "why", "code": "b"}
    assert json.loads(one(spark, Pr.literal_json("t"), t="{'sequential': False, 'n': None}")) == {"sequential": False, "n": None}
    assert R.single_deletion("keep this clause, and that", "keep and that") == "this clause, " and R.single_deletion("abc", "xbc") is None
    assert one(spark, Rp.lookup_k(F.create_map(F.lit("5"), F.lit(0.5)), 5)) == 0.5
    assert one(spark, Rp.scalar_or_mean(F.lit(None).cast("double"), F.array(F.lit(1.0), F.lit(None), F.lit(2.0)))) == 1.5
    with pytest.raises(Exception, match="unknown event kind"):
        Rp.public_events(spark.createDataFrame([("x", 1)], "event string, v int"), {"y": ["v"]}).collect()
    kept, idle = Rp.select_paths(spark.createDataFrame([("a/b.py",), ("a/c.md",)], "path string"), ["a/*"], ["**/*.md", "z/*"])
    assert [r[0] for r in kept.collect()] == ["a/b.py"] and [r[0] for r in idle.collect()] == ["z/*"]
    full, cut = (spark.createDataFrame([(v,)], "estimate double") for v in (0.421, 0.158))
    assert round(Rp.share_lost(full, cut).first()["lost"], 2) == 0.62


def test_first_available_and_progress(spark, tmp_path):
    from quarrystone.streaming.progress import ProgressLog

    (tmp_path / "a.jsonl").write_text("")
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n')
    read = lambda p: readers.read_jsonl(spark, p, "id string")
    assert readers.first_available(spark, [None, str(tmp_path / "no"), str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], read).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [str(tmp_path / "no")], read)
    assert ProgressLog().rows == []


def test_gates_that_raise_and_cohorts(spark):
    rows = spark.createDataFrame([(1, "s", "a", 1.0), (1, "t", "b", 0.0)], "c int, k string, arm string, v double")
    with pytest.raises(G.GateError, match="several clusters"):
        P.pivot_arms(rows, "c", "k", "arm", "v", ["a", "b"], "intersection")
    other = spark.createDataFrame([(1, "s", "z", 1.0)], "c int, k string, arm string, v double")
    with pytest.raises(G.GateError, match="without any"):
        P.pivot_arms(other, "c", "k", "arm", "v", ["a", "b"])
    with pytest.raises(ValueError, match="no clusters"):
        P.cluster_bootstrap(rows.where("c = 2"), "k", "v", 10)
    names = spark.createDataFrame([("a", "/x"), ("b", "/x/y/"), ("c", "/xy"), ("d", "/x")], "n string, p string")
    assert {tuple(r) for r in G.shared_paths(names, "n", "p").collect()} == {("a", "b"), ("d", "b"), ("a", "d"), ("d", "a")}
    expected = rows.select("c").distinct()
    with pytest.raises(G.GateError, match="repeated"):
        G.roster_complete(rows, expected, ["c"])
    G.roster_complete(expected, expected, ["c"])
    texts = spark.createDataFrame([(1, "say abcd now"), (2, None), (3, "")], "i int, t string")
    tokens = spark.createDataFrame([("abc",), ("bcd",), ("",), (None,), ("xyz",)], "w string")
    for block in (100, 1):
        assert {tuple(r) for r in G.leaked_identifiers(texts, "t", tokens, "w", ["i"], block).collect()} == {(1, "abc"), (1, "bcd")}
    good = [(str(i), k, "PROVED" if k == "golden_vs_golden" else "COUNTEREXAMPLE" if i else "UNSUPPORTED", True, f"{k}{i}", "p", True) for i in range(5) for k in ("golden_vs_golden", "golden_vs_mutant")]
    ddl = "case_id string, comparison string, status string, replayed boolean, run_id string, protocol string, qualified boolean"
    assert G.calibration(spark.createDataFrame(good, ddl), 5, ["0"]).first()["passed"]
    assert not G.calibration(spark.createDataFrame(good[:-1], ddl), 5, ["0"]).first()["passed"] and not G.calibration(spark.createDataFrame(good, ddl), 5).first()["passed"]
    full = [(a, str(i), None, None, "PROVED", "PASS", True) for a in ("m", "n") for i in range(4)]
    kind = "arm string, case_id string, mode string, nonresearch boolean, formal_status string, simulation_status string, replayed boolean"
    assert all(r["passed"] for r in G.primary_coverage(spark.createDataFrame(full, kind), ["m", "n"], 4, 3).collect())
    assert not any(r["passed"] for r in G.primary_coverage(spark.createDataFrame([*full, ("m", "9", None, None, None, None, None)], kind), ["m", "n"], 4, 3).collect())
    with pytest.raises(Exception, match="record drifted"):
        D.resolve(spark.createDataFrame([(1, "x")], "k int, d string"), spark.createDataFrame([(1, "y", 2)], "k int, d string, z int"), "k", "d").collect()
    with pytest.raises(ValueError, match="empty"):
        D.allowlist_split(rows, "c", rows.select("k").where("k = 'q'"), F.col("k"))


def test_json_walks(spark):
    from quarrystone.functions import json_tree as J

    clean = J.Sanitizer({"case7": "main_1"}, ("Ann",))
    assert clean.value({"Authors": ["x"], "a": ["case7 by ann", 3, None], "git-url": "x"}) == {"Authors": "[ANONYMIZED]", "a": ["main_1 by [ANONYMIZED]", 3, None], "git-url": "[REDACTED_GIT_REMOTE]"}
    with pytest.raises(ValueError, match="collapse"):
        clean.value({"case7": 1, "main_1": 2})
    with pytest.raises(ValueError, match="3 characters"):
        J.Sanitizer(people=("x",))
    assert J.private_places({"rows": [{"Raw Response": 1, "ok": {"thinking": 2}}]}) == ["$.rows[0].Raw Response", "$.rows[0].ok.thinking"]
    assert list(J.strings({"a": ["x", {"b": "y"}], "c": "z"})) == ["x", "y", "z"]
    assert one(spark, J.sanitized("t"), t="{bad") ["error"] == "no JSON" and one(spark, J.private_fields("t"), t="no") == ["$"]


def test_sinks_keep_the_earlier_version_and_torn_logs(spark, tmp_path):
    df = spark.range(3)
    for n in (3, 2):
        sinks.write_jsonl(df.limit(n), str(tmp_path / "t"), overwrite=True)
        sinks.write_document(spark, {"n": n}, str(tmp_path / "d.json"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2 and json.loads((tmp_path / "d.json").read_text()) == {"n": 2}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["d.json", "t"]
    log = tmp_path / "log"
    log.mkdir()
    (log / "a").write_text("one\ntwo\nthr")
    (log / "b").write_text("four\n\n")
    (log / "c").write_text("")
    assert sorted(r["value"] for r in readers.whole_lines(spark, str(log)).collect()) == ["four", "one", "two"]

"""Queries of gates, cohorts, validation jobs, rebuilt sources, sanitized documents, and of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_tree as J
from ..functions import prompts
from ..functions import header as H
from ..functions import rtl as R
from ..functions import text as T
from ..operators import datagen as D
from ..operators import gates as G
from ..operators import ledger as L
from ..operators import paired as P
from ..operators import reports as Rp
from ..operators import rules as Ru
from ..sources import readers, sinks
from ..sources.scratch import scratch
from ..streaming import ledger as S
from .registry import query

#: Body of a module m(input clk, input [3:0] d, output reg [3:0] q, output y), why it is refused, and how it drives an input.
_SAID = {
    "check": "formal constraint/check statement",
    "design": "embedded verification or additional design construct",
    "force": "cross-hierarchy force/release",
    "root": "root hierarchy access",
    "scope": "hierarchical or cross-scope reference",
    "attribute": "source attribute",
    "directive": "preprocessor directive",
    "drive": "drive of input port",
    "gate": "primitive drive of input port",
    "again": "input direction redeclaration",
}
CONSTRUCTS = [
    ("assign q = d + 4'd1;", "", ""),
    ("initial q = 0; assign y = $high(d);", "", ""),
    ("always @(*) begin q = d; end", "", ""),
    ("always @(posedge clk) if (d <= 4'd3) q <= d;", "", ""),
    ("sub u(.d(d), .y(y)); // assert $finish", "", ""),
    ("assert property (q);", "check", ""),
    ("restrict property (q);", "check", ""),
    ("property p; endproperty", "design", ""),
    ("interface i; endinterface", "design", ""),
    ("always @* force q = 1;", "force", ""),
    ("assign y = $root.top;", "root", ""),
    ("assign y = u.secret;", "scope", ""),
    ("(* keep *) wire w;", "attribute", ""),
    ("`include \"x.v\"", "directive", ""),
    ("initial $finish;", "system task/function $finish", ""),
    ("assign {d, q} = 8'd0;", "", "drive"),
    ("always @(posedge clk) d[1] <= q[0];", "", "drive"),
    ("always @* d++;", "", "drive"),
    ("always @* d ^= q;", "", "drive"),
    ("alias d = q;", "", "drive"),
    ("input d;", "", "again"),
    ("buf (d, q);", "", "gate"),
    ("nand #(2) n1(y, d, q);", "", ""),
    ("tran (q, d);", "", "gate"),
    ("assign y = q ? d <= 4'd2 : d <= 4'd3;", "", ""),
]
_REASON = lambda k: "candidate security preflight rejected " + _SAID.get(k, k) if k else ""
_EXPECTED = ", ".join(f"({i}, '{_REASON(a)}', '{_REASON(b)}')" for i, (_, a, b) in enumerate(CONSTRUCTS))


@query(f"SELECT p_partkey, refused, driven FROM part JOIN (VALUES {_EXPECTED}) v(i, refused, driven) ON p_partkey % {len(CONSTRUCTS)} = i")
def candidate_gate(table, spark, sf):
    """A module of each part, whose ports are named by its words, with one of the constructs, through both gates."""
    names = {"d": F.concat(F.split("p_name", " ")[0], F.lit("_in")), "q": F.concat(F.split("p_name", " ")[1], F.lit("_out")), "y": F.concat(F.lower("p_type"), F.lit("_y"))}
    bodies = F.array(*[F.lit(b) for b, _, _ in CONSTRUCTS])
    source = F.concat(F.lit("module m(input clk, input [3:0] d, output reg [3:0] q, output y);\n"), F.get(bodies, (F.col("p_partkey") % len(CONSTRUCTS)).cast("int")), F.lit("\nendmodule\n"))
    for port, name in names.items():
        source = F.regexp_replace(source, F.lit(rf"\b{port}\b"), name)
    return table("part").select("p_partkey", R.refused(source).alias("refused"), H.driven_input(source).alias("driven"))


_COHORT = """r AS (SELECT o_orderkey, o_custkey, trim('rtl ' || o_totalprice) AS rtl FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority < '4'),
v AS (SELECT l_orderkey, min(l_shipdate)::DATE::VARCHAR AS w FROM lineitem GROUP BY 1 HAVING max(l_returnflag) = 'R' AND max(l_linestatus) = 'O')"""


@query(f"WITH {_COHORT} SELECT o_custkey AS case_id, o_orderkey AS call_id, md5(rtl) AS candidate_md5, w AS witness FROM r JOIN v ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def feedback_cohort(table, spark, sf):
    orders = table("orders")
    responses = orders.select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "shift").otherwise("main").alias("mode"), F.when(F.col("o_orderpriority") < "4", "spec0_loc0").otherwise("spec1_loc0").alias("arm"), F.lit("accepted_pending_compile").alias("model_outcome"), F.concat(F.lit(" rtl "), F.col("o_totalprice")).alias("parsed_rtl"))
    verdicts = table("lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg((F.max("l_linestatus") == "O").alias("compiled"), F.when(F.max("l_returnflag") == "R", "counterexample").otherwise("PROVED").alias("formal_status"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("witness"))
    got = L.feedback_cohort(table("customer").select(F.col("c_custkey").alias("case_id")), responses, verdicts)
    return got.select("case_id", "call_id", F.md5("previous_candidate").alias("candidate_md5"), "witness")


@query("""SELECT o_orderkey AS call_id, 'seed' || c_nationkey AS seed_id, sha256('rtl ' || o_orderkey) AS candidate_sha256, CASE WHEN o_orderstatus = 'O' THEN 'golden ' || o_custkey || chr(10) END AS golden_rtl,
CASE WHEN o_orderstatus <> 'O' THEN '/golden/' || o_custkey END AS golden_path, CASE WHEN o_orderstatus = 'O' THEN sha256('golden ' || o_custkey || chr(10)) ELSE sha256(o_custkey::VARCHAR) END AS golden_sha256
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def validation_jobs(table, spark, sf):
    text = lambda c: F.col(c).cast("string")
    responses = table("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "shift").otherwise("main").alias("mode"), F.lit("accepted_pending_compile").alias("model_outcome"), F.concat(F.lit("rtl "), text("o_orderkey")).alias("parsed_rtl"))
    responses = responses.withColumn("parsed_rtl_sha256", F.sha2("parsed_rtl", 256))
    customers = table("customer").withColumn("source_case_id", F.col("c_custkey"))
    record = F.sha2(F.concat(F.lit("record "), text("c_custkey")), 256)
    cases = customers.select(F.col("c_custkey").alias("case_id"), "source_case_id", F.concat(F.lit("seed"), text("c_nationkey")).alias("validation_seed_id"), record.alias("source_sha256"))
    shift = customers.select("source_case_id", F.concat(F.lit("golden "), text("c_custkey"), F.lit("  ")).alias("golden_rtl"), record.alias("record_sha256"))
    canonical = customers.select("source_case_id", F.concat(F.lit("/golden/"), text("c_custkey")).alias("golden_path"), F.sha2(text("c_custkey"), 256).alias("golden_sha256"))
    verdicts = table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("call_id")).distinct()
    return L.validation_jobs(responses, verdicts, cases, shift, canonical)


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'PROVED' WHEN p_size = 2 THEN 'UNSUPPORTED' ELSE 'COUNTEREXAMPLE' END AS status FROM part), c AS (SELECT count(*) AS n FROM part)
SELECT n AS n_golden, n AS n_mutant, 2 * n AS n_rows, n AS golden_proved, (SELECT count(*) FROM m WHERE status = 'PROVED') AS false_proofs, (SELECT count(*) FROM m WHERE status = 'COUNTEREXAMPLE') AS replayed,
(SELECT count(*) FROM m WHERE status = 'UNSUPPORTED') AS n_fallback, n AS golden_cases, n AS mutant_cases, 2 * n AS n_runs, 0::BIGINT AS n_unpaired, false AS passed FROM c""")
def calibration_gate(table, spark, sf):
    part = table("part").select(F.col("p_partkey").cast("string").alias("case_id"), "p_size")
    gold = part.select("case_id", F.lit("golden_vs_golden").alias("comparison"), F.lit("PROVED").alias("status"))
    status = F.when(F.col("p_size") == 1, "PROVED").when(F.col("p_size") == 2, "UNSUPPORTED").otherwise("COUNTEREXAMPLE")
    mutant = part.select("case_id", F.lit("golden_vs_mutant").alias("comparison"), status.alias("status"))
    rows = gold.unionByName(mutant).withColumns({"replayed": F.lit(True), "run_id": F.concat_ws(":", "comparison", "case_id"), "protocol": F.lit("p1"), "qualified": F.lit(False)})
    return G.calibration(rows, 85, ["7"]).select("n_golden", "n_mutant", "n_rows", "golden_proved", "false_proofs", "replayed", "n_fallback", "golden_cases", "mutant_cases", "n_runs", "n_unpaired", "passed")


@query("""WITH r AS (SELECT l_returnflag AS arm, l_orderkey AS c, CASE WHEN l_quantity < 20 THEN 'PROVED' WHEN l_quantity < 40 THEN 'COUNTEREXAMPLE' ELSE 'TIMEOUT' END AS f, CASE WHEN l_discount < 0.03 THEN 'COUNTEREXAMPLE' WHEN l_discount < 0.09 THEN 'PASS' ELSE 'TIMEOUT' END AS s, l_tax > 0.02 AS replayed FROM lineitem),
a AS (SELECT DISTINCT arm, c FROM r), o AS (SELECT x.arm, (SELECT count(*) FROM a WHERE a.arm = x.arm AND c NOT IN (SELECT c FROM a WHERE arm = 'A')) + (SELECT count(*) FROM a WHERE arm = 'A' AND c NOT IN (SELECT c FROM a b WHERE b.arm = x.arm)) AS n FROM (SELECT DISTINCT arm FROM r) x)
SELECT arm, count(*) AS n_records, count(DISTINCT c) AS n_cases, count(*) FILTER (f = 'PROVED' OR (f = 'COUNTEREXAMPLE' AND replayed)) AS n_definitive, count(*) FILTER (f = 'PROVED' AND s = 'COUNTEREXAMPLE') AS n_conflicts, count(*) FILTER (s = 'TIMEOUT') AS n_inconclusive, any_value(o.n) AS n_roster, false AS passed FROM r JOIN o USING (arm) GROUP BY arm""")
def primary_gate(table, spark, sf):
    rows = table("lineitem").select(
        F.col("l_returnflag").alias("arm"),
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.lit("main").alias("mode"),
        F.lit(False).alias("nonresearch"),
        F.when(F.col("l_quantity") < 20, "PROVED").when(F.col("l_quantity") < 40, "COUNTEREXAMPLE").otherwise("TIMEOUT").alias("formal_status"),
        F.when(F.col("l_discount") < 0.03, "COUNTEREXAMPLE").when(F.col("l_discount") < 0.09, "PASS").otherwise("TIMEOUT").alias("simulation_status"),
        (F.col("l_tax") > 0.02).alias("replayed"),
    )
    return G.primary_coverage(rows, ["A", "N", "R"], 85, 77).select("arm", "n_records", "n_cases", "n_definitive", "n_conflicts", "n_inconclusive", "n_roster", "passed")


@query("""WITH g AS (SELECT l_returnflag AS family, l_suppkey, avg(l_discount - 0.05) AS m FROM lineitem GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY l_suppkey) - 1 AS i FROM g),
z AS (SELECT family, count(*) AS n, avg(m) AS estimate FROM c GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY family) - 1 + 5 AS s FROM z),
d AS (SELECT k.family, r.rep, ('0x' || substr(md5(k.s || ':' || r.rep || ':' || q.slot), 1, 8))::BIGINT % k.n AS i FROM k, (SELECT unnest(range(500)) AS rep) r, LATERAL (SELECT unnest(range(k.n)) AS slot) q),
e AS (SELECT family, rep, avg(m) AS est FROM d JOIN c USING (family, i) GROUP BY ALL)
SELECT family, any_value(k.estimate) AS estimate, any_value(k.n) AS n_clusters, quantile_cont(est, 0.025) AS low, quantile_cont(est, 0.975) AS high, least(1.0, 2 * least(count(*) FILTER (est <= 0) + 1, count(*) FILTER (est >= 0) + 1) / 501) AS p FROM e JOIN k USING (family) GROUP BY family""")
def family_bootstrap(table, spark, sf):
    rows = table("lineitem").select(F.col("l_returnflag").alias("family"), "l_suppkey", (F.col("l_discount") - 0.05).alias("effect"))
    return P.family_bootstrap(rows, "family", "l_suppkey", "effect", 500, 5)


@query("""SELECT doc_id, 'verilogeval:' || source AS eval_id, source IN (SELECT source FROM documents WHERE lang = 'de') AS kept FROM documents""")
def allowlist_split(table, spark, sf):
    docs = table("documents").select("doc_id", "source", "lang")
    allowed = docs.where("lang = 'de'").select(T.seed_to_eval_id("source").alias("eval_id"))
    return D.allowlist_split(docs.select("doc_id", F.concat("source", F.lit("_ref")).alias("seed")), "doc_id", allowed, T.seed_to_eval_id("seed")).select("doc_id", "eval_id", "kept")


@query("""SELECT count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_found, avg(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1.0 ELSE 0.0 END) >= 0.3 AS passed FROM documents""")
def match_rate_gate(table, spark, sf):
    rows = table("documents").select("doc_id").join(table("labels").select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    return D.match_rate(rows, F.col("has"), 0.3)


@query("""SELECT doc_id, md5(text) AS recorded, md5(replace(text, 'The ', 'A ')) AS found FROM documents WHERE contains(text, 'The ')""")
def digest_drift_gate(table, spark, sf):
    docs = table("documents")
    changed = docs.select("doc_id", F.md5(F.replace("text", F.lit("The "), F.lit("A "))).alias("sha256"))
    return G.digest_drift(docs.select("doc_id", F.md5("text").alias("sha256")), changed, "doc_id")


@query("""SELECT doc_id, b.lang, md5(b.text) AS text_md5 FROM labels JOIN documents b USING (doc_id)""")
def resolved_selection(table, spark, sf):
    docs = table("documents").select("doc_id", "lang", "text", F.sha2("text", 256).alias("digest"))
    chosen = table("labels").select("doc_id").join(docs.select("doc_id", "digest"), "doc_id")
    return D.resolve(chosen, docs, "doc_id", "digest").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("""WITH d AS (SELECT doc_id, source FROM documents), s AS (SELECT DISTINCT source AS id FROM d), a AS (SELECT id AS old, id FROM s UNION ALL SELECT id || '_ref', id FROM s)
SELECT 'case' || doc_id AS old, 'main_' || doc_id AS new FROM d UNION ALL SELECT old, min('design_' || substr(sha256('public-design' || chr(0) || id), 1, 16)) FROM a GROUP BY old""")
def alias_map(table, spark, sf):
    docs = table("documents").select(F.concat(F.lit("case"), F.col("doc_id")).alias("case_id"), F.col("source").alias("seed_id"), F.concat(F.lit("main_"), F.col("doc_id")).alias("anonymous_id"))
    return D.aliases(docs, ["case_id"], ["seed_id"], "anonymous_id")


def _payload(bad):
    nested = F.struct(F.col("value").cast("int").alias("k"), F.when(bad, "secret thoughts").alias("Chain-of Thought"))
    return F.to_json(F.struct(F.lit("Ann").alias("author"), F.lit("key").alias("api-key"), F.concat(F.lit("mail u"), F.col("user_id"), F.lit("@host.org or see /home/u"), F.col("user_id"), F.lit("/x")).alias("note"), F.array(nested).alias("rows")))


@query("""SELECT event_id, '{"api-key":"[REDACTED]","author":"[ANONYMIZED]","note":"mail [REDACTED_EMAIL] or see <LOCAL_PATH>","rows":[{' || CASE WHEN event_type = 'error' THEN '"Chain-of Thought":"secret thoughts",' ELSE '' END || '"k":' || trunc(value)::INTEGER || '}]}' AS clean, CASE WHEN event_type = 'error' THEN '$.rows[0].Chain-of Thought' ELSE '' END AS private FROM events""")
def sanitized_events(table, spark, sf):
    rows = table("events").select("event_id", J.examined(_payload(F.col("event_type") == "error")).alias("x"))
    return rows.select("event_id", F.col("x.value").alias("clean"), F.array_join("x.places", ",").alias("private"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN sha1('module ' || lower(replace(p_name, ' ', '_') || p_type) || '; endmodule') ELSE '' END AS prints FROM part""")
def embedded_sources(table, spark, sf):
    source = F.concat(F.lit("MODULE "), F.translate("p_name", " ", "_"), "p_type", F.lit(";  // "), "p_brand", F.lit("\n endmodule "))
    rows = table("part").withColumn("doc", F.to_json(F.struct(F.array(F.struct(F.when(F.col("p_size") % 2 == 0, source).otherwise("none").alias("x"))).alias("rows"), F.col("p_name").alias("name"))))
    return rows.select("p_partkey", F.array_join(J.embedded_prints("doc"), ",").alias("prints"))


_BLOCK = "'module b' || p_partkey || '; endmodule'"


@query(f"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN {_BLOCK} WHEN 1 THEN {_BLOCK} WHEN 2 THEN NULL ELSE NULL END AS code, CASE p_size % 4 WHEN 3 THEN 'no code here' ELSE 'Because.' END AS explanation FROM part""")
def answer_blocks(table, spark, sf):
    """Tagged behind an untagged one, untagged with a module, of another language, none."""
    block = F.concat(F.lit("module b"), F.col("p_partkey"), F.lit("; endmodule"))
    fence = lambda tag, body: F.concat(F.lit(f"```{tag}\n"), body, F.lit("\n```\n"))
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, F.concat(F.lit("Because.\n"), fence("", F.lit("x")), fence("verilog", block))).when(kind == 1, F.concat(F.lit("Because.\n"), fence("", block), fence("py", F.lit("y")))).when(kind == 2, F.concat(F.lit("Because.\n"), fence("py", F.lit("module")))).otherwise("no code here")
    return table("part").select("p_partkey", prompts.explanation_and_code(text)["code"].alias("code"), prompts.explanation_and_code(text)["explanation"].alias("explanation"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'module ' || replace(p_name, ' ', '_') || ' (input a);' || chr(10) || 'assign b = a;' || chr(10) || 'endmodule' ELSE 'module k (x);' || chr(10) || 'assign b = a;' || chr(10) || 'endmodule' END AS source FROM part""")
def rebuilt_modules(table, spark, sf):
    code = F.when(F.col("p_size") % 3 == 0, "assign b = a;").otherwise(" assign b = a;\nendmodule ")
    first = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("[INST] A "), F.lower("p_type"), F.lit(" one. module "), F.translate("p_name", " ", "_"), F.lit(" (input a); [/INST]"))).otherwise("module a (x); then a module without one")
    return table("part").select("p_partkey", T.full_module(code, [first, F.lit("module k (x); end")]).alias("source"))


@query("""WITH l AS (SELECT p_partkey, ['%Warning-WIDTH: ' || p_name, '%Warning-UNUSED: x', '%Error: ' || p_brand, 'note'] AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x: regexp_matches(x, '^%Error') OR regexp_matches(x, '^%Warning-(WIDTH|LATCH)[^A-Z0-9]')), '|') AS diagnostics FROM l""")
def lint_diagnostics(table, spark, sf):
    log = F.concat(F.lit("  %Warning-WIDTH: "), F.col("p_name"), F.lit("\n%Warning-UNUSED: x\n%Error: "), F.col("p_brand"), F.lit(" \nnote\n"))
    return table("part").select("p_partkey", F.array_join(T.gating_diagnostics(log), "|").alias("diagnostics"))


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'base' ELSE 'adapter' END AS source_group, CASE WHEN p_size % 2 = 0 THEN 'sequential' ELSE 'combinational' END AS timing,
(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS code_lines, p_size % 3 = 0 AS has_case, p_size % 5 = 0 AS has_state FROM part""")
def source_strata(table, spark, sf):
    model = F.when(F.col("p_size") < 20, " Base").when(F.col("p_size") < 35, "tuned").otherwise("adapter_v2")
    body = F.concat(F.when(F.col("p_size") % 2 == 0, "// edge\nalways @ ( posedge clk )\n").otherwise(""), F.lit("q"), F.when(F.col("p_size") % 3 == 0, "case").otherwise(""), F.when(F.col("p_size") % 5 == 0, "STATE").otherwise(""))
    t = T.taxonomy(body)
    return table("part").select("p_partkey", T.source_group(model).alias("source_group"), T.timing(t["sequential"]).alias("timing"), t["code_lines"].alias("code_lines"), t["has_case"].alias("has_case"), t["has_state"].alias("has_state"))


_RUNS = """r AS (SELECT model, version, signal, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'lint' ELSE 'semantic' END AS bucket, ('0x' || substr(md5(model || version || signal || p_partkey), 1, 4))::INTEGER % 3 > 0 AS recovered
 FROM part, (VALUES ('base'), ('tuned')) m(model), (VALUES ('20240101'), ('20240301')) v(version), (VALUES ('diag'), ('spec')) s(signal)), n AS (SELECT * FROM r WHERE version = '20240301')"""


def _runs(table):
    rows = table("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "lint").otherwise("semantic").alias("bucket"))
    for name, values in (("model", ["base", "tuned"]), ("version", ["20240101", "20240301"]), ("signal", ["diag", "spec"])):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.withColumn("recovered", F.conv(F.substring(F.md5(F.concat("model", "version", "signal", F.col("id").cast("string"))), 1, 4), 16, 10).cast("int") % 3 > 0)


def _specialized(table):
    expected = [("base", "diag"), ("base", "spec"), ("tuned", "diag"), ("tuned", "spec")]
    return Rp.specialization(_runs(table), expected, ["lint", "semantic"], ("base", "diag"), ("tuned", "diag"), "semantic")


@query(f"WITH {_RUNS} SELECT model, signal, bucket, count(*) AS n, count(*) FILTER (recovered) AS n_recovered, count(*) FILTER (recovered) / count(*) AS rate FROM n GROUP BY ALL")
def specialization_arms(table, spark, sf):
    return _specialized(table)[0]


@query(f"""WITH {_RUNS}, p AS (SELECT id, bool_or(recovered) FILTER (model = 'base') AS a, bool_or(recovered) FILTER (model = 'tuned') AS b FROM n WHERE signal = 'diag' AND bucket = 'semantic' GROUP BY id)
SELECT count(*) AS n, count(*) FILTER (a) AS base_recovered, count(*) FILTER (b) AS tuned_recovered, count(*) FILTER (a AND NOT b) AS base_only, count(*) FILTER (b AND NOT a) AS tuned_only FROM p""")
def specialization_contrast(table, spark, sf):
    return _specialized(table)[1].drop("p_exact")


@query("""SELECT e.event_id, e.value FROM events e WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50) AND NOT value < 1""")
def scoped_rows(table, spark, sf):
    rows = table("events").select("event_id", F.concat(F.col("event_type"), F.lit(" ")).alias("mode"), "user_id", "value", (F.col("value") < 1).alias("nonresearch"))
    allowed = table("events").where("event_type = 'signup' AND value > 50").select("user_id")
    return L.scoped(rows, "click", allowed, "user_id", True).select("event_id", "value")


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_left, (SELECT count(DISTINCT doc_id) FROM labels) AS n_right, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_both""")
def roster_overlap(table, spark, sf):
    return G.overlap_size(table("documents"), table("labels"), ["doc_id"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 9000")
def range_gate(table, spark, sf):
    return G.outside(table("customer"), "c_acctbal", 0, 9000).select("c_custkey", "c_acctbal")


@query("""SELECT r_name AS outer_name, n_name AS inner_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def shared_path_gate(table, spark, sf):
    """A folder for each region, and one below it for each of its nations."""
    regions = table("region").select(F.col("r_name").alias("name"), F.concat(F.lit("/runs/r"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("path"))
    nations = table("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("/runs/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string")).alias("path"))
    got = G.shared_paths(regions.unionByName(nations), "name", "path")
    return got.select(F.col("outer").alias("outer_name"), F.col("inner").alias("inner_name"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + 1 AS attempt_number FROM customer""")
def next_attempt_numbers(table, spark, sf):
    return L.next_attempts(table("customer").select("c_custkey"), table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT o_orderkey, true AS diagnostic FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)""")
def limited_run(table, spark, sf):
    rows = table("orders").select("o_orderkey", (-F.col("o_totalprice")).alias("place"))
    return Rp.marked_limit(rows, ["place", "o_orderkey"], 25).select("o_orderkey", "diagnostic")


@query("""WITH w AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (length(text) > 1000)::DOUBLE AS k FROM documents GROUP BY 1)
SELECT lang, (1.96 / (1 + 1.96 * 1.96 / n)) * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) AS half FROM w WHERE k > 5 AND n - k > 5""")
def interval_halves(table, spark, sf):
    from ..functions import stats

    w = table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 1000).alias("k")).where("k > 5 AND n - k > 5")
    i = stats.wilson(F.col("k"), F.col("n"))
    return w.select("lang", Rp.half_width(i["low"], i["high"]).alias("half"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jsonl_round_trip(table, spark, sf):
    """Written as JSON lines, twice over the same name, and read strictly."""
    path = scratch(spark, "nation")
    for _ in range(2):
        sinks.write_jsonl(table("nation"), path, overwrite=True)
    return readers.read_jsonl(spark, path, table("nation").schema, "strict")


@query("SELECT p_partkey, p_name FROM part")
def log_lines(table, spark, sf):
    """An appended log read by whole lines."""
    path = scratch(spark, "log")
    part = table("part").select("p_partkey", "p_name")
    sinks.append(part.where("p_size < 25"), path)
    sinks.append(part.where("NOT p_size < 25"), path)
    return readers.whole_lines(spark, path).select(F.from_json("value", "p_partkey long, p_name string").alias("r")).select("r.*")


@query("""WITH r AS (SELECT o_orderpriority AS model, CASE WHEN o_orderstatus = 'P' THEN '2' ELSE '1' END AS version, 's' AS signal, o_orderkey FROM orders)
SELECT model, version, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS total FROM r GROUP BY ALL""")
def partitioned_runs(table, spark, sf):
    """Runs put into their partitions and read back by their folders."""
    path = scratch(spark, "runs")
    runs = table("orders").select(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "P", "v2").otherwise("v1").alias("version"), F.lit("s").alias("signal"), "o_orderkey")
    sinks.put_run(runs, path)
    got = spark.read.parquet(path)
    return got.groupBy("model", F.substring("version", 2, 1).alias("version")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("total"))


@query("""WITH r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT r.event_id, v.event_id AS verdict_id FROM r LEFT JOIN v ON v.user_id = r.user_id AND v.ts >= r.ts AND v.ts <= r.ts + INTERVAL 6 HOUR""")
def stream_matches(table, spark, sf):
    """Responses of the event stream with the verdicts that follow within six hours, and those that none follows.

    An event of either kind long after all others moves the watermark past them, so that every response is decided.
    """
    src, out, checkpoint = (scratch(spark, n) for n in ("events", "matches", "checkpoint"))
    events = table("events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(src)
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit("click").alias("event_type")), F.struct(F.lit(-2).cast("long").alias("event_id"), F.lit("purchase").alias("event_type")))).alias("e"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))

    def run() -> None:
        read = lambda kind: S.read_events(spark, src, events.schema).where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
        both = S.matched(read("click"), read("purchase"), "user_id", "ts", "6 hours", "1 hour")
        made = both.select(F.col("r.event_id").alias("event_id"), F.col("v.event_id").alias("verdict_id"))
        made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()

    run()
    last.select("user_id", "e.event_id", "e.event_type", "ts").select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).write.mode("append").parquet(src)
    run()  # goes on from the checkpoint
    return spark.read.parquet(out).where("event_id >= 0")


_RESULTS = """r AS (SELECT 'shift' AS mode, arm, c_custkey::VARCHAR AS case_id, CASE WHEN c_custkey % 31 = 0 AND arm = 'b' THEN 'other' ELSE 'n' || c_nationkey END AS seed_id, CASE WHEN c_acctbal > 0 THEN c_acctbal > 5000 END AS success, CASE WHEN c_acctbal <= 0 THEN c_custkey % 37 = 0 END AS resolved,
CASE WHEN c_custkey % 41 = 0 THEN 'PROVED' ELSE 'timeout' END AS formal_status, CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNSUPPORTED' ELSE 'COMPILE_FAIL' END AS simulation_status, CASE WHEN c_custkey % 43 > 0 THEN c_mktsegment END AS reason, dirty
FROM customer, (VALUES ('a'), ('b')) a(arm), (VALUES (true), (false)) d(dirty) WHERE NOT (dirty AND c_custkey % 29 = 0 AND arm = 'a')),
f AS (SELECT * REPLACE (CASE WHEN dirty THEN seed_id ELSE 's' END AS seed_id, CASE WHEN dirty THEN resolved WHEN success IS NULL THEN false END AS resolved, CASE WHEN dirty THEN formal_status ELSE 'TIMEOUT' END AS formal_status, CASE WHEN dirty THEN reason ELSE 'r' END AS reason) FROM r), n AS (SELECT count(*) AS n FROM customer), k AS (FROM (VALUES (true), (false)) k(dirty))"""
_COUNTED = {
    "manifest size": "0",
    "number of results": "(SELECT (count(*) <> 2 * any_value(n.n))::INTEGER FROM f, n WHERE f.dirty = k.dirty)",
    "missing result": "(SELECT 2 * any_value(n.n) - count(*) FROM f, n WHERE f.dirty = k.dirty)",
    "one seed a case": "(SELECT count(*) FROM (SELECT case_id FROM f WHERE f.dirty = k.dirty GROUP BY 1 HAVING count(DISTINCT seed_id) > 1))",
    "null success is unresolved": "(SELECT count(*) FROM f WHERE f.dirty = k.dirty AND success IS NULL AND resolved)",
    "inconclusive formal status": "(SELECT count(*) FROM f WHERE f.dirty = k.dirty AND success IS NULL AND formal_status = 'PROVED')",
    "reason of an inconclusive result": "(SELECT count(*) FROM f WHERE f.dirty = k.dirty AND success IS NULL AND reason IS NULL)",
}
_ZERO = ["unexpected arm", "case and seed are named", "not in the manifest", "repeated result", "success against resolved", "inconclusive simulation status"]


@query(f"WITH {_RESULTS} SELECT dirty, rule, n_violations::BIGINT AS n_violations, n_violations = 0 AS passed FROM (" + " UNION ALL ".join([f"SELECT dirty, '{name}' AS rule, {sql} AS n_violations FROM k" for name, sql in _COUNTED.items()] + [f"SELECT dirty, '{name}', 0 FROM k" for name in _ZERO]) + ")")
def frozen_grid_gate(table, spark, sf):
    """A grid of customers and two arms against its rules, once as it should be and once with every kind of defect that its rows can have."""
    customer = table("customer")
    expected = customer.count()
    manifest = customer.select(F.col("c_custkey").cast("string").alias("case_id"))
    key, text = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    base = D.arm_grid(customer, ["a", "b"]).withColumn("mode", F.lit("shift")).withColumn("case_id", text("c_custkey")).withColumn("success", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 5000))
    simulated = F.when(F.col("c_mktsegment") == "BUILDING", "UNSUPPORTED").otherwise("COMPILE_FAIL")
    dirty = base.where(~((key % 29 == 0) & (F.col("arm") == "a"))).select("mode", "arm", "case_id", F.when((key % 31 == 0) & (F.col("arm") == "b"), "other").otherwise(F.concat(F.lit("n"), text("c_nationkey"))).alias("seed_id"), "success", F.when(F.col("c_acctbal") <= 0, key % 37 == 0).alias("resolved"), F.when(key % 41 == 0, "PROVED").otherwise("timeout").alias("formal_status"), simulated.alias("simulation_status"), F.when(key % 43 > 0, F.col("c_mktsegment")).alias("reason"))
    clean = base.select("mode", "arm", "case_id", F.lit("s").alias("seed_id"), "success", F.when(F.col("success").isNull(), F.lit(False)).alias("resolved"), F.lit("TIMEOUT").alias("formal_status"), simulated.alias("simulation_status"), F.lit("r").alias("reason"))
    said = [Ru.grid_report(rows, manifest, ["a", "b"], expected).select(F.lit(d).alias("dirty"), "rule", "n_violations", "passed") for rows, d in ((dirty, True), (clean, False))]
    return said[0].unionByName(said[1])

"""Queries of statistics, gates, readers and digests over grids, logs and records of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rtl as R
from ..functions import stats as St
from ..operators import datagen as D
from ..operators import gates as G
from ..operators import ledger as L
from ..operators import paired as P
from ..operators import reports as Rp
from ..sources import readers
from ..sources.scratch import scratch
from .registry import query

_TAIL = "CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda k: exp(lgamma(x + y + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - (x + y) * ln(2))))) END"


@query("""WITH g AS (SELECT o_custkey, c_nationkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
i AS (SELECT c_nationkey, avg(o - f) AS m, count(*) AS n FROM g WHERE o IS NOT NULL AND f IS NOT NULL GROUP BY 1), s AS (SELECT c_nationkey, avg(c_acctbal / 2) AS m, count(*) AS n FROM customer GROUP BY 1)
SELECT 'intersection' AS policy, avg(m) AS estimate, count(*) AS n_clusters, sum(n)::BIGINT AS n_cases FROM i UNION ALL SELECT 'strict', avg(m), count(*), sum(n)::BIGINT FROM s""")
def paired_policies(table, spark, sf):
    """Arms paired on the customers that have both, and on a grid in which every customer must have both."""
    orders = table("orders").where("o_orderstatus IN ('F', 'O')").join(table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    some = orders.groupBy("o_custkey", "c_nationkey", F.col("o_orderstatus").alias("arm")).agg(F.avg("o_totalprice").alias("y"))
    both = P.pivot_arms(some, "o_custkey", "c_nationkey", "arm", "y", ["F", "O"], "intersection").withColumn("d", P.difference("F", "O"))
    full = D.arm_grid(table("customer"), ["a", "b"]).withColumn("y", F.when(F.col("arm") == "a", F.col("c_acctbal") / 2).otherwise(F.col("c_acctbal")))
    every = P.pivot_arms(full, "c_custkey", "c_nationkey", "arm", "y", ["a", "b"], "strict").withColumn("d", P.difference("a", "b"))
    one = lambda df, name: P.macro_mean(df, "c_nationkey", "d").select(F.lit(name).alias("policy"), "estimate", "n_clusters", "n_cases")
    return one(both, "intersection").unionByName(one(every, "strict"))


@query(f"""WITH c AS (SELECT l_shipdate::DATE AS day, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS r, l_linestatus FROM lineitem GROUP BY l_shipdate::DATE, l_linestatus),
n AS (SELECT l_linestatus, count(*) FILTER (r > a) AS x, count(*) FILTER (r < a) AS y, count(*) FILTER (r = a) AS ties, avg(CASE WHEN r > a THEN 1.0 WHEN r < a THEN 0.0 END) AS share FROM c WHERE a IS NOT NULL AND r IS NOT NULL GROUP BY 1)
SELECT l_linestatus, x AS up, y AS down, ties, round({_TAIL}, 9) AS p, share - 0.4 >= 0.1 AND share - 0.45 > 0 AS material FROM n""")
def sign_tests(table, spark, sf):
    """Whether one kind of line outweighs another day by day, with an exact sign test and a materiality rule."""
    day = table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_linestatus").agg(*[F.sum(F.when(F.col("l_returnflag") == k, F.col("l_extendedprice"))).alias(k.lower()) for k in "AR"]).where("a IS NOT NULL AND r IS NOT NULL")
    n = day.groupBy("l_linestatus").agg(F.count_if(F.expr("r > a")).alias("up"), F.count_if(F.expr("r < a")).alias("down"), F.count_if(F.expr("r = a")).alias("ties"), F.avg(F.when(F.expr("r > a"), 1.0).when(F.expr("r < a"), 0.0)).alias("share"))
    return n.select("l_linestatus", "up", "down", "ties", F.round(St.sign_test(F.col("up"), F.col("down")), 9).alias("p"), St.material(F.col("share") - 0.4, F.col("share") - 0.45).alias("material"))


@query("""SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS reasoning, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS output FROM lineitem GROUP BY 1) WHERE NOT (reasoning >= 0 AND reasoning <= output AND output <= 120)""")
def token_accounting_gate(table, spark, sf):
    """Orders whose returned quantity, as if tokens of reasoning, exceeds their open one, or whose open one a budget."""
    q = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("reasoning"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).alias("output"))
    return G.token_accounting(q, "reasoning", "output", 120).select("o_orderkey")


@query("""WITH r AS (SELECT event_type <> 'error' AS resolved, event_type AS reason FROM events) SELECT count(*) AS n_cases, count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (NOT resolved) AS n_errors, count(*) FILTER (resolved) / count(*)::DOUBLE AS share FROM r""")
def coverage_counts(table, spark, sf):
    """Counts alone of what is resolved, with the reasons of the rest."""
    got = L.coverage(table("events").select((F.col("event_type") != "error").alias("resolved"), F.col("event_type").alias("reason")))
    return got.select("n_cases", "n_resolved", F.element_at("reason_counts", "error").alias("n_errors"), "share")


@query("""SELECT count(*) FILTER (event_type = 'view') AS attempts, count(*) FILTER (event_type = 'click') AS responses, count(*) FILTER (event_type = 'view') - count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS retries, count(*) FILTER (event_type = 'error') AS transport_errors, count(*) FILTER (event_type = 'purchase') AS verdicts FROM events""")
def ledger_totals(table, spark, sf):
    kinds = {"view": "request_attempt", "click": "response", "error": "transport_error", "purchase": "verdict"}
    event = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return L.counters(table("events").select(F.try_element_at(event, F.col("event_type")).alias("event"), F.col("user_id").alias("call_id")))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size = 7) AS f FROM part) SELECT k.defect, n AS n_golden, n AS n_mutant, n AS golden_proved, CASE WHEN k.defect = 'a proof' THEN 1 ELSE 0 END::BIGINT AS false_proofs, CASE WHEN k.defect = 'a proof' THEN n - f - 1 ELSE n - f END AS replayed, f AS n_fallback,
CASE WHEN k.defect = 'no partner' THEN 2 ELSE 0 END::BIGINT AS n_unpaired, k.defect = 'none' AS passed FROM n, (VALUES ('none'), ('a proof'), ('no partner')) k(defect)""")
def calibration_cases(table, spark, sf):
    """A calibration that passes, with cases that are told apart in another way, and two that do not."""
    part = table("part").select(F.col("p_partkey").cast("string").alias("case_id"), "p_size")
    fallback = [r["case_id"] for r in part.where("p_size = 7").select("case_id").collect()]  # the named exceptions of a protocol
    count = part.count()
    gold = part.select("case_id", "p_size", F.lit("golden_vs_golden").alias("comparison"), F.lit("PROVED").alias("status"), F.lit(False).alias("qualified"))
    other = F.col("p_size") == 7
    mutant = part.select("case_id", "p_size", F.lit("golden_vs_mutant").alias("comparison"), F.when(other, "UNSUPPORTED").otherwise("COUNTEREXAMPLE").alias("status"), other.alias("qualified"))
    rows = gold.unionByName(mutant).withColumns({"replayed": F.lit(True), "run_id": F.concat_ws(":", "comparison", "case_id"), "protocol": F.lit("p1")})
    key = part.where("p_size <> 7").agg(F.min(F.col("case_id").cast("long"))).first()[0]
    one = (F.col("case_id") == str(key)) & (F.col("comparison") == "golden_vs_mutant")
    kinds = {"none": rows, "a proof": rows.withColumn("status", F.when(one, "PROVED").otherwise(F.col("status"))), "no partner": rows.withColumn("case_id", F.when(one, F.concat(F.lit("x"), "case_id")).otherwise(F.col("case_id")))}
    names = ["n_golden", "n_mutant", "golden_proved", "false_proofs", "replayed", "n_fallback", "n_unpaired", "passed"]
    made = [G.calibration(df, count, fallback).select(F.lit(name).alias("defect"), *names) for name, df in kinds.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("""WITH r AS (SELECT model || signal AS x FROM (VALUES ('base')) m(model), (VALUES ('diag')) s(signal)), n AS (SELECT p_partkey AS id, ('0x' || substr(md5('base' || '20240301' || 'diag' || p_partkey), 1, 4))::INTEGER % 3 > 0 AS a, ('0x' || substr(md5('tuned' || '20240301' || 'diag' || p_partkey), 1, 4))::INTEGER % 3 > 0 AS b FROM part WHERE p_size % 3 <> 0),
c AS (SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM n) SELECT n, x AS base_only, y AS tuned_only, round(""" + _TAIL + """, 9) AS p_exact FROM c""")
def specialization_test(table, spark, sf):
    """The exact test of the contrast of two models."""
    from .gate_queries import _specialized

    return _specialized(table)[1].select("n", "base_only", "tuned_only", F.round("p_exact", 9).alias("p_exact"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = 1 THEN max(l_discount) ELSE avg(l_quantity) FILTER (l_linenumber <> 2) END AS derived FROM lineitem GROUP BY 1""")
def derived_rows(table, spark, sf):
    """A number where a record has one, else the mean of its nested numbers without nulls."""
    g = table("lineitem").groupBy("l_orderkey").agg(F.when(F.count(F.lit(1)) == 1, F.max("l_discount")).alias("scalar"), F.collect_list(F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("v"))).alias("q"))
    return g.select("l_orderkey", Rp.scalar_or_mean(F.col("scalar"), F.col("q.v")).alias("derived"))


@query("""SELECT c_custkey, sha256('{"balance":{"key":' || c_nationkey || ',"z":[' || c_custkey || ',null,"é"]},"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS record_sha256 FROM customer""")
def canonical_records(table, spark, sf):
    """Digests of records whose keys stand in no order, with spaces, nested, with a null and a letter that need not be escaped."""
    text = F.concat(F.lit('{ "segment" : "'), "c_mktsegment", F.lit('", "name": "'), "c_name", F.lit('",\n "balance": {"z": ['), F.col("c_custkey").cast("string"), F.lit(', null, "\\u00e9"], "key": '), F.col("c_nationkey").cast("string"), F.lit("}}"))
    return table("customer").select("c_custkey", R.canonical_sha256(text).alias("record_sha256"))


@query("""SELECT 'skip' AS policy, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'tolerant', count(*), sum(c_custkey)::BIGINT FROM customer""")
def permissive_readers(table, spark, sf):
    """JSON lines of which some are torn or are an id alone: bad ones dropped, or read as ids."""
    path = scratch(spark, "lines")
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 7 == 0, key).otherwise(F.concat(F.lit('{"id": "'), key, F.lit('", "name": "'), "c_name", F.lit('"}')))
    table("customer").select(line.alias("value")).unionByName(table("customer").where("c_custkey % 50 = 0").select(F.lit("  ").alias("value"))).write.text(path)
    kept = readers.read_jsonl(spark, path, "id string, name string", "skip").where("name IS NOT NULL").select("id")
    every = readers.read_jsonl(spark, path, "id string", "tolerant")
    one = lambda df, name: df.agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("total"))
    return one(kept, "skip").unionByName(one(every, "tolerant"))


@query("""SELECT p_partkey, 'out[' || p_size || ']' AS output, p_size::BIGINT AS mismatches, (p_partkey + 100)::BIGINT AS samples, (5 * p_size)::BIGINT AS first_mismatch_time FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, NULL, 0, (p_partkey + 100)::BIGINT, NULL FROM part WHERE p_size % 2 = 1""")
def simulator_traces(table, spark, sf):
    """Totals and the first mismatch of a simulator's log of each part."""
    size, key = F.col("p_size").cast("string"), (F.col("p_partkey") + 100).cast("string")
    hint = F.concat(F.lit("Hint: Output '"), F.lit("out["), size, F.lit("]' has "), size, F.lit(" mismatches. First mismatch occurred at time "), (5 * F.col("p_size")).cast("string"), F.lit(".\n"))
    log = F.concat(F.when(F.col("p_size") % 2 == 0, hint).otherwise("Hint: Output 'out' has no mismatches.\n"), F.lit("Hint: Total mismatched samples is given below\nMismatches: "), F.when(F.col("p_size") % 2 == 0, size).otherwise("0"), F.lit("  in  "), key, F.lit(" samples\n"))
    return table("part").select("p_partkey", readers.parse_trace(log).alias("t")).select("p_partkey", "t.*")

"""Queries over the event ledger: duplicate policies, verdict joins, outcomes, resume points, gates, newest slots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datagen as D
from ..operators import gates as G
from ..operators import ledger as L
from ..sources.scratch import scratch
from ..sources.sinks import newest_runs, run_index
from ..streaming import ledger as S
from .registry import query

_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = '{}') WHERE n = 1)"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = '{}') WHERE n = 1)"


def _events(table, kind):
    return table("events").where(F.col("event_type") == kind)


@query(f"SELECT user_id, event_id, value FROM {_FIRST.format('click')}")
def ledger_first_wins(table, spark, sf):
    return L.deduplicate(_events(table, "click"), ["user_id"], ["ts", "event_id"], "first").select("user_id", "event_id", "value")


@query(f"SELECT user_id, event_id, value FROM {_LAST.format('click')}")
def ledger_last_wins(table, spark, sf):
    return L.deduplicate(_events(table, "click"), ["user_id"], ["ts", "event_id"], "last").select("user_id", "event_id", "value")


@query("SELECT user_id, count(*) AS n_rows FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) > 1")
def ledger_duplicates(table, spark, sf):
    return G.duplicate_keys(_events(table, "click"), ["user_id"])


def _judged(table, least=0):
    responses = L.deduplicate(_events(table, "click").where(F.col("value") >= least), ["user_id"], ["ts", "event_id"], "first").select("user_id", F.col("value").alias("score"), "event_type")
    verdicts = L.deduplicate(_events(table, "purchase"), ["user_id"], ["ts", "event_id"], "last").select("user_id", F.col("value").alias("verdict_value"), "event_type")
    return responses, verdicts


@query(f"""SELECT r.user_id, r.value AS score, v.value AS verdict_value, coalesce(v.event_type, r.event_type) AS event_type
FROM {_FIRST.format('click')} r LEFT JOIN {_LAST.format('purchase')} v ON v.user_id = r.user_id""")
def responses_with_verdicts(table, spark, sf):
    return L.with_verdicts(*_judged(table), "user_id", override=["event_type"])


@query(f"SELECT v.user_id, v.value AS verdict_value, v.event_type FROM {_LAST.format('purchase')} v WHERE v.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value >= 40)")
def orphan_verdicts(table, spark, sf):
    responses, verdicts = _judged(table, 40)
    return L.orphans(verdicts, responses, "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pending_jobs(table, spark, sf):
    return L.pending(table("customer").select("c_custkey"), table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS attempt_number FROM events")
def attempt_numbers(table, spark, sf):
    return L.attempts(table("events"), "user_id", "ts", "event_id").select("event_id", "attempt_number")


_STATUS = """CASE WHEN {0} % 7 = 0 THEN 'TIMEOUT' WHEN {0} % 7 = 1 THEN 'COUNTEREXAMPLE' WHEN {0} % 7 = 2 THEN 'COMPILE_FAIL' WHEN {0} % 7 = 3 THEN 'UNSUPPORTED' ELSE 'PROVED' END"""
_SIM = """CASE WHEN {0} % 5 = 0 THEN 'TIMEOUT' WHEN {0} % 5 = 1 THEN 'COUNTEREXAMPLE' ELSE 'PASS' END"""


@query(f"""
WITH e AS (SELECT event_id, event_id % 3 <> 0 AS accepted, event_id % 7 <> 2 AS compiled, {_STATUS.format('event_id')} AS f, {_SIM.format('event_id')} AS s, event_id % 11 <> 0 AS replayed, event_id % 2 = 0 AS shift FROM events),
v AS (SELECT *, CASE WHEN NOT accepted THEN NULL WHEN compiled = (f = 'COMPILE_FAIL') THEN 'compile_formal_contradiction' WHEN NOT compiled THEN NULL
 WHEN f = 'PROVED' AND s = 'COUNTEREXAMPLE' THEN 'proof_simulation_conflict' WHEN f = 'COUNTEREXAMPLE' AND NOT replayed THEN 'counterexample_not_replayed'
 WHEN f IN ('TIMEOUT', 'UNSUPPORTED') AND s = 'TIMEOUT' AND NOT shift THEN 'no_definitive_simulation' END AS violation FROM e)
SELECT event_id, violation,
 CASE WHEN violation IS NOT NULL THEN NULL WHEN NOT accepted OR NOT compiled THEN false WHEN f = 'PROVED' THEN true WHEN f = 'COUNTEREXAMPLE' THEN false WHEN s <> 'TIMEOUT' THEN s = 'PASS' END AS success,
 CASE WHEN violation IS NOT NULL OR NOT accepted THEN NULL WHEN NOT compiled THEN 'compile_fail' WHEN f = 'PROVED' THEN 'unbounded_formal_proof' WHEN f = 'COUNTEREXAMPLE' THEN 'replayable_formal_counterexample'
 WHEN s <> 'TIMEOUT' THEN 'independent_simulation_fallback_after_' || lower(f) ELSE 'inconclusive_shift_validation' END AS evidence FROM v""")
def outcome_policy(table, spark, sf):
    accepted = F.col("event_id") % 3 != 0
    only = lambda c: F.when(accepted, c)
    got = table("events").withColumn(
        "o",
        L.outcome(
            F.when(accepted, "accepted_pending_compile").otherwise("refusal"),
            only(F.col("event_id") % 7 != 2),
            only(F.expr(_STATUS.format("event_id"))),
            only(F.expr(_SIM.format("event_id"))),
            F.col("event_id") % 11 != 0,
            F.col("event_id") % 2 == 0,
        ),
    )
    return got.select("event_id", "o.violation", "o.success", "o.evidence")


@query("""SELECT event_type AS event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type""")
def ledger_counters(table, spark, sf):
    return table("events").groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def newest_per_slot(table, spark, sf):
    return L.latest(table("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT o_orderpriority AS model, strftime(o_orderdate, '%Y%m%d') AS version, o_orderstatus AS signal FROM orders),
m AS (SELECT model, signal, max(version) AS version FROM r GROUP BY ALL)
SELECT r.model, r.version, r.signal, count(*) AS n_rows FROM r JOIN m USING (model, version, signal) GROUP BY ALL""")
def newest_run_index(table, spark, sf):
    runs = table("orders").select(F.col("o_orderpriority").alias("model"), F.date_format("o_orderdate", "yyyyMMdd").alias("version"), F.col("o_orderstatus").alias("signal"))
    return run_index(newest_runs(runs))


@query("""SELECT doc_id, CASE WHEN l.d IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id, 1 AS x FROM documents) d FULL JOIN (SELECT doc_id, 1 AS d FROM labels) l USING (doc_id) WHERE d.x IS NULL OR l.d IS NULL""")
def roster_difference(table, spark, sf):
    return G.one_sided_keys(table("documents"), table("labels"), ["doc_id"])


@query("SELECT lang, side FROM (SELECT lang, 'left' AS side FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT lang, 'right' FROM (SELECT lang FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang FROM documents WHERE doc_id % 2 = 0))")
def multiset_gate(table, spark, sf):
    docs = table("documents")
    return G.multiset_difference(docs.where("doc_id % 2 = 0").select("lang"), docs.where("doc_id % 2 = 1").select("lang"))


@query("SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def consistency_gate(table, spark, sf):
    return G.inconsistent_attribute(table("documents"), "source", "lang")


@query("""SELECT l_orderkey, count(*) AS n_cells, count(DISTINCT l_returnflag) AS n_arms FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT l_returnflag) <> 2""")
def grid_gate(table, spark, sf):
    return G.incomplete_grid(table("lineitem"), "l_orderkey", "l_returnflag", ["A", "R"])


@query("""WITH f AS (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1), r AS (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT f.o_orderpriority, f.mean AS mean_frozen, r.mean AS mean_rebuilt FROM f JOIN r USING (o_orderpriority) WHERE abs(f.mean - r.mean) > 1""")
def drift_gate(table, spark, sf):
    mean = lambda df: df.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return G.drift(mean(table("orders")), mean(table("orders").where("o_orderstatus <> 'P'")), ["o_orderpriority"], {"mean": 1.0})


@query("""SELECT c_custkey, arm, sha256('quarrystone-order-7' || chr(0) || c_custkey || chr(0) || arm) AS position FROM customer, (VALUES ('base'), ('spec'), ('loc'), ('both')) a(arm)""")
def schedule_grid(table, spark, sf):
    return D.arm_grid(table("customer").select("c_custkey"), ["base", "spec", "loc", "both"]).withColumn("position", D.seeded_order(7, "c_custkey", "arm"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upserted(table, spark, sf):
    old = table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return D.upsert(old, new, "o_orderkey")


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND count(DISTINCT l_returnflag) = 1""")
def stub_keys(table, spark, sf):
    return D.stubs(table("lineitem"), "l_orderkey", "l_returnflag")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(60.0, greatest(0.0, value)) ELSE least(30.0, pow(2.0, greatest(0, user_id % 6 - 1))) * (0.75 + 0.5 * (('0x' || substr(sha256(user_id || chr(0) || user_id % 6), 1, 4))::INTEGER / 65535.0)) END AS delay FROM events""")
def retry_delays(table, spark, sf):
    return table("events").select("event_id", T.retry_delay(F.col("user_id").cast("string"), F.col("user_id") % 6, F.when(F.col("event_id") % 4 == 0, F.col("value"))).alias("delay"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type")
def stream_running_rates(table, spark, sf):
    """The running rates of the event stream, read to its end."""
    stream = S.read_events(spark, f"{sf}/events.parquet*", table("events").schema)
    name = f"rates_{uuid.uuid4().hex}"
    q = S.running_rates(stream, ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName(name)
    q.option("checkpointLocation", scratch(spark, "rates")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)

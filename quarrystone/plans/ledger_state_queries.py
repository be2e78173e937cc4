"""Queries of the commit log, hash trees and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests as G
from ..sources import commits
from ..sources.scratch import scratch
from ..streaming import latest
from ..streaming import ledger as S
from .registry import query


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN c_acctbal > 5000 THEN 'done' END AS result,
CASE WHEN c_acctbal > 5000 THEN 3 WHEN c_acctbal > 0 THEN 2 ELSE 1 END::BIGINT AS last_commit FROM customer""")
def committed_attempts(table, spark, sf):
    """Attempts committed before work, a second one of some, results of a few behind theirs; read back by commit."""
    log = commits.CommitLog(spark, scratch(spark, "log"))
    jobs = table("customer").select("c_custkey", "c_acctbal")
    commits.record_attempts(log, jobs, "c_custkey")
    commits.record_attempts(log, jobs.where("c_acctbal > 0"), "c_custkey")
    commits.record_results(log, jobs.where("c_acctbal > 5000").select("c_custkey", F.lit(2).cast("long").alias("attempt"), F.lit("done").alias("result")), "c_custkey")
    log.compact()
    rows = log.snapshot()
    return rows.groupBy("c_custkey").agg(F.max(F.when(F.col("result").isNull(), F.col("attempt"))).alias("attempts"), F.max("result").alias("result"), F.max("commit").alias("last_commit"))


def _sql_text(*columns: str) -> str:
    return " || ',' || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR, '') || ':' || coalesce({c}::VARCHAR, '')" for c in columns)


def _sql_leaves(rows: str, depth: int, key: str, *columns: str) -> str:
    sums = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS s{i}" for i in range(8))
    return f"SELECT prefix, n, sha256(n::VARCHAR || ',' || {" || ',' || ".join(f's{i}' for i in range(8))}) AS digest FROM (SELECT substr(md5({_sql_text(key)}), 1, {depth}) AS prefix, count(*) AS n, {sums} FROM (SELECT {key}, sha256({_sql_text(key, *columns)}) AS h FROM {rows}) GROUP BY 1)"


@query(f"""WITH l2 AS ({_sql_leaves('orders', 2, 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority')}),
l1 AS (SELECT substr(prefix, 1, 1) AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest FROM l1)
FROM l0 UNION ALL FROM l1 UNION ALL FROM l2""")
def digest_tree(table, spark, sf):
    return G.tree(table("orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"], 2)


_DRIFT = "CASE WHEN o_orderkey % 911 = 5 THEN 'missing' WHEN o_orderkey % 977 = 6 THEN 'changed' WHEN o_orderkey % 1009 = 7 THEN 'extra' END"


@query(f"""SELECT CASE WHEN what = 'extra' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey, what FROM (SELECT o_orderkey, {_DRIFT} AS what FROM orders) WHERE what IS NOT NULL""")
def digest_drift(table, spark, sf):
    """A table against its lock: rows gone, changed and new are found in the ranges whose digests differ."""
    columns = ["o_custkey", "o_orderstatus"]
    old = table("orders").select("o_orderkey", *columns)
    tagged = old.withColumn("what", F.expr(_DRIFT))
    new = tagged.where("coalesce(what, '') <> 'missing'").withColumn("o_orderstatus", F.when(F.col("what") == "changed", "?").otherwise(F.col("o_orderstatus")))
    extra = tagged.where("what = 'extra'").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    new = new.unionByName(extra).drop("what")
    path = scratch(spark, "lock")
    G.lock(spark, old, ["o_orderkey"], columns, path)
    ranges = G.drifted(spark.read.parquet(path), G.tree(new, ["o_orderkey"], columns)).select("prefix")
    return G.differing_rows(old, new, ["o_orderkey"], columns, ranges)


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def stream_newest(table, spark, sf):
    """The newest event of each user and kind, by a stream over files that come in two runs of it."""
    src, out, checkpoint = (scratch(spark, n) for n in ("events", "changes", "state"))
    events = table("events").select("user_id", "event_type", "event_id", "value")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(src)
        stream = S.read_events(spark, src, events.schema)
        changed = latest.changes(stream.withColumn("seq", F.col("event_id")), ["user_id", "event_type"], "seq", ["event_id", "value"], "last")
        latest.run_changes(changed, out, checkpoint)
    return latest.current(spark, out, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")

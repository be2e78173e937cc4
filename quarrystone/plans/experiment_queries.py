"""Queries of paired experiment statistics over labels, documents, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import paired as P
from .registry import query

_PAIRS = "p AS (SELECT l.doc_id, d.source, d.lang, l.quality::DOUBLE AS a, l.toxic::DOUBLE AS b FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL)"


def _pairs(table):
    """Labels as two arms of each document, clustered by source."""
    labels = table("labels")
    rows = labels.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("quality", "toxic"))).alias("arm", "success"))
    rows = rows.join(table("documents").select("doc_id", "source", "lang"), "doc_id")
    cells = P.pivot_arms(rows, "doc_id", "source", "arm", "success", ["a", "b"], "definitive")
    return cells.join(table("documents").select("doc_id", "lang"), "doc_id").withColumn("effect", P.difference("a", "b"))


@query(f"WITH {_PAIRS}, m AS (SELECT source, avg(b - a) AS m, count(*) AS n FROM p GROUP BY source) SELECT avg(m) AS estimate, count(*) AS n_clusters, sum(n)::BIGINT AS n_cases FROM m")
def macro_effect(table, spark, sf):
    return P.macro_mean(_pairs(table), "source", "effect")


@query(f"WITH {_PAIRS}, m AS (SELECT lang, source, avg(b - a) AS m, count(*) AS n FROM p GROUP BY ALL) SELECT lang, avg(m) AS estimate, count(*) AS n_clusters, sum(n)::BIGINT AS n_cases FROM m GROUP BY lang")
def macro_effect_by_family(table, spark, sf):
    return P.macro_mean(_pairs(table), "source", "effect", ["lang"])


_TAIL = "CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda k: exp(lgamma(x + y + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - (x + y) * ln(2))))) END"


@query(f"""WITH {_PAIRS}, c AS (SELECT lang, count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y, count(*) FILTER (a = 0 AND b = 0) AS neither FROM p GROUP BY lang)
SELECT lang, "both", x AS only_a, y AS only_b, neither, 100.0 * (y - x) / ("both" + x + y + neither) AS diff_pp, round({_TAIL}, 9) AS p_exact FROM c""")
def contingency_by_family(table, spark, sf):
    return P.contingency(_pairs(table), "a", "b", ["lang"]).withColumn("p_exact", F.round("p_exact", 9))


@query(f"""WITH {_PAIRS}, c AS (SELECT lang, count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y FROM p GROUP BY lang), q AS (SELECT lang, {_TAIL} AS p FROM c),
r AS (SELECT lang, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, lang) + 1) * p) AS raw FROM q)
SELECT lang, round(p, 9) AS p, round(max(raw) OVER (ORDER BY p, lang), 9) AS p_holm FROM r""")
def holm_across_families(table, spark, sf):
    tests = P.contingency(_pairs(table), "a", "b", ["lang"]).select("lang", F.col("p_exact").alias("p"))
    return S.holm(tests, "p", "lang").select("lang", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query("""WITH c AS (SELECT d.lang, sum(l.quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1)
SELECT lang, k / n AS rate, greatest(0.0, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) - (1.96 / (1 + 3.8416/n)) * sqrt(k/n * (1 - k/n) / n + 3.8416/(4*n*n))) AS low,
least(1.0, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) + (1.96 / (1 + 3.8416/n)) * sqrt(k/n * (1 - k/n) / n + 3.8416/(4*n*n))) AS high FROM c""")
def wilson_by_family(table, spark, sf):
    rows = table("labels").where("quality IS NOT NULL").join(table("documents").select("doc_id", "lang"), "doc_id")
    c = rows.groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    return c.select("lang", S.rate(F.col("k"), F.col("n")).alias("rate"), S.wilson(F.col("k"), F.col("n")).alias("w")).select("lang", "rate", "w.low", "w.high")


@query("""WITH q AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, n, c, CASE WHEN c = 0 THEN 0.0 ELSE c / n END AS pass_at_1, CASE WHEN c = 0 THEN 0.0 WHEN c >= n OR n - c < 2 THEN 1.0 ELSE 1.0 - ((n - c) * (n - c - 1)) / (n * (n - 1))::DOUBLE END AS pass_at_2 FROM q""")
def pass_at_k(table, spark, sf):
    q = table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("c"))
    return q.select("l_orderkey", "n", "c", S.pass_at_k(F.col("n"), F.col("c"), 1).alias("pass_at_1"), S.pass_at_k(F.col("n"), F.col("c"), 2).alias("pass_at_2"))


@query("""WITH q AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
SELECT o_orderpriority, avg(c / n) AS pass_at_1, count(*) AS n_problems FROM q JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def mean_pass_at_k(table, spark, sf):
    q = table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("c"))
    q = q.join(table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return q.groupBy("o_orderpriority").agg(F.avg(S.pass_at_k(F.col("n"), F.col("c"), 1)).alias("pass_at_1"), F.count(F.lit(1)).alias("n_problems"))


@query("""WITH v AS (SELECT c_nationkey, floor(avg(c_acctbal) / 500) AS x, count(*) AS y FROM customer GROUP BY 1),
r AS (SELECT (SELECT count(*) FROM v b WHERE b.x <= a.x) - 1 AS rx, (SELECT count(*) FROM v b WHERE b.y <= a.y) - 1 AS ry FROM v a)
SELECT round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1)), 2)::DOUBLE AS rho, count(*) AS n FROM r""")
def rank_correlation(table, spark, sf):
    v = table("customer").groupBy("c_nationkey").agg(F.floor(F.avg("c_acctbal") / 500).alias("x"), F.count(F.lit(1)).alias("y"))
    return S.spearman(v, "x", "y")


@query(f"""WITH {_PAIRS}, c AS (SELECT source, avg(b - a) AS m, row_number() OVER (ORDER BY source) - 1 AS i FROM p GROUP BY source), k AS (SELECT count(*) AS n FROM c),
d AS (SELECT r.rep, ('0x' || substr(md5('42:' || r.rep || ':' || s.slot), 1, 8))::BIGINT % k.n AS i FROM k, (SELECT unnest(range(2000)) AS rep) r, LATERAL (SELECT unnest(range(k.n)) AS slot) s),
e AS (SELECT rep, avg(m) AS est FROM d JOIN c USING (i) GROUP BY rep),
t AS (SELECT quantile_cont(est, 0.025) AS low, quantile_cont(est, 0.975) AS high, least(1.0, 2 * least(count(*) FILTER (est <= 0) + 1, count(*) FILTER (est >= 0) + 1) / 2001) AS p FROM e)
SELECT (SELECT avg(m) FROM c) AS estimate, (SELECT n FROM k) AS n_clusters, low, high, p FROM t""")
def bootstrap_effect(table, spark, sf):
    return P.cluster_bootstrap(_pairs(table), "source", "effect", replicates=2000)


@query(f"""WITH {_PAIRS}, c AS (SELECT lang, avg(b - a) AS m, stddev_pop(b - a) AS sd, min(b - a) AS lo, max(b - a) AS hi, quantile_cont(a + b, 0.25) AS q25 FROM p GROUP BY lang)
SELECT lang, m AS mean_effect, sd, lo, hi, q25, CASE WHEN m - 0.1 > 0 OR m + 0.1 < 0 THEN 'material' WHEN m - 0.1 > -0.1 AND m + 0.1 < 0.1 THEN 'bounded_null' ELSE 'inconclusive' END AS verdict FROM c""")
def effect_summary(table, spark, sf):
    c = _pairs(table).groupBy("lang").agg(F.avg("effect").alias("mean_effect"), F.stddev_pop("effect").alias("sd"), F.min("effect").alias("lo"), F.max("effect").alias("hi"), F.percentile(F.col("a") + F.col("b"), F.lit(0.25)).alias("q25"))
    return c.withColumn("verdict", S.three_way(F.col("mean_effect") - 0.1, F.col("mean_effect") + 0.1))


_GRID = """g AS (SELECT o_custkey, c_nationkey, avg(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS y00, avg(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderpriority >= '3') AS y01,
avg(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority < '3') AS y10, avg(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority >= '3') AS y11 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query(f"""WITH {_GRID}, d AS (SELECT c_nationkey, avg((y11 - y01) - (y10 - y00)) AS m, count(*) AS n FROM g WHERE y00 IS NOT NULL AND y01 IS NOT NULL AND y10 IS NOT NULL AND y11 IS NOT NULL GROUP BY 1)
SELECT avg(m) AS estimate, count(*) AS n_clusters, sum(n)::BIGINT AS n_cases FROM d""")
def interaction_effect(table, spark, sf):
    """Difference in differences over a two by two grid of each customer's orders, clustered by nation."""
    orders = table("orders").where("o_orderstatus IN ('F', 'O')").join(table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    arm = F.concat(F.lit("y"), F.when(F.col("o_orderstatus") == "O", "1").otherwise("0"), F.when(F.col("o_orderpriority") >= "3", "1").otherwise("0"))
    cells = orders.groupBy("o_custkey", "c_nationkey", arm.alias("arm")).agg(F.avg("o_totalprice").alias("y"))
    grid = P.pivot_arms(cells, "o_custkey", "c_nationkey", "arm", "y", ["y00", "y01", "y10", "y11"], "definitive")
    return P.macro_mean(grid.withColumn("d", P.difference_in_differences("y00", "y01", "y10", "y11")), "c_nationkey", "d")


@query("""WITH t AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') + 1 AS r FROM conversations GROUP BY 1)
SELECT k.round::INTEGER AS round, (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM t WHERE r <= k.round) AS solved FROM (SELECT unnest(range(1, 6)) AS round) k""")
def cumulative_recovery(table, spark, sf):
    first = table("conversations").groupBy("conv_id").agg((F.min(F.when(F.col("role") == "assistant", F.col("turn"))) + 1).alias("r"))
    return P.cumulative_by_round(first, "r", 5)


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS family, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS mutation, count(*) AS both_fail FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 0 GROUP BY ROLLUP (lang, source)""")
def survivor_rollup(table, spark, sf):
    both = table("labels").where("quality = 0 AND toxic = 0").join(table("documents").select("doc_id", "lang", "source"), "doc_id")
    got = both.rollup("lang", "source").agg(F.count(F.lit(1)).alias("both_fail"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return got.select(F.when(F.col("gl") == 1, "all").otherwise(F.col("lang")).alias("family"), F.when(F.col("gs") == 1, "all").otherwise(F.col("source")).alias("mutation"), "both_fail")


@query("""SELECT k AS cases, count(*) AS tasks FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY 1""")
def histogram_of_counts(table, spark, sf):
    return table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cases")).groupBy("cases").agg(F.count(F.lit(1)).alias("tasks"))


@query("""SELECT o_orderpriority AS arm, n, CASE WHEN n >= 3050 THEN 'HAVE' WHEN n > 0 THEN 'PARTIAL' ELSE 'NEED' END AS coverage FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def coverage_audit(table, spark, sf):
    n = table("orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("coverage", F.when(F.col("n") >= 3050, "HAVE").when(F.col("n") > 0, "PARTIAL").otherwise("NEED"))


@query(f"WITH {_PAIRS}, m AS (SELECT lang, source, avg(1 - a) AS m, count(*) AS n FROM p GROUP BY ALL) SELECT lang, avg(m) AS ceiling, count(*) AS n_clusters, sum(n)::BIGINT AS n_cases FROM m GROUP BY lang")
def attainable_ceiling(table, spark, sf):
    return P.attainable(_pairs(table), "source", "a", ["lang"])


@query("""SELECT l_shipmode_flag, median_qty, spread FROM (SELECT l_returnflag AS l_shipmode_flag, quantile_cont(l_quantity, 0.5) AS median_qty, max(l_extendedprice) - min(l_extendedprice) AS spread FROM lineitem GROUP BY 1)""")
def spread_by_flag(table, spark, sf):
    return table("lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode_flag")).agg(F.percentile("l_quantity", F.lit(0.5)).alias("median_qty"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"))


@query("""SELECT source, lang, n, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS share, rank() OVER (PARTITION BY source ORDER BY n DESC)::INTEGER AS place FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)""")
def stratum_shares(table, spark, sf):
    n = table("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("source")
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("place", F.rank().over(w.orderBy(F.desc("n"))))

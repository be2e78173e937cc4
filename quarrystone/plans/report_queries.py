"""Queries of summaries, agreement, draws, cohorts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import gates as G
from ..operators import reports as Rp
from .registry import query


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_recovered, count(*) FILTER (o_totalprice > 100000) AS n_used,
round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS recovered_rate, round(count(*) FILTER (o_totalprice > 100000) / count(*), 4) AS used_rate FROM orders GROUP BY 1""")
def bucket_summary(table, spark, sf):
    rows = table("orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("recovered"), (F.col("o_totalprice") > 100000).alias("used"))
    return Rp.summary_by(rows, ["o_orderpriority"], ["recovered", "used"])


@query("""WITH r AS (SELECT l_linestatus, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS s, CASE WHEN l_quantity < 20 THEN true WHEN l_quantity > 30 THEN false END AS f FROM lineitem)
SELECT l_linestatus, count(*) FILTER (s AND f) AS agree_pass, count(*) FILTER (NOT s AND NOT f) AS agree_fail, count(*) FILTER (s AND NOT f) AS sim_false_pass, count(*) FILTER (NOT s AND f) AS sim_false_diverge, count(*) FILTER (s IS NULL OR f IS NULL) AS no_formal FROM r GROUP BY 1""")
def verdict_agreement(table, spark, sf):
    rows = table("lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("s"),
        F.when(F.col("l_quantity") < 20, True).when(F.col("l_quantity") > 30, False).alias("f"),
    )
    return Rp.agreement(rows, "s", "f", ["l_linestatus"])


@query("""WITH m AS (SELECT l_linenumber, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL), d AS (SELECT l_linenumber, avg(m) AS e FROM m GROUP BY 1)
SELECT avg(e) AS mean, min(e) AS low, max(e) AS high, stddev_pop(e) AS sd, count(*) AS n_draws FROM d""")
def effect_over_draws(table, spark, sf):
    return Rp.over_draws(table("lineitem"), "l_linenumber", "l_suppkey", "l_discount")


@query("""WITH c AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') - 100000 AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') - 100000 AS b FROM orders GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) FILTER (sign(a) <> 0 AND sign(b) <> 0) AS decided, count(*) FILTER (sign(a) <> 0 AND sign(b) <> 0 AND sign(a) <> sign(b)) AS reversed, avg(b - a) AS mean_shift, min(b - a) AS low_shift, max(b - a) AS high_shift FROM c""")
def sign_reversal_report(table, spark, sf):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) - 100000
    c = table("orders").groupBy("o_custkey").agg(mean("F").alias("a"), mean("O").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return Rp.sign_reversals(c, "a", "b")


@query("""SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def complete_cohort(table, spark, sf):
    return Rp.complete_cases(table("lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("""WITH t AS (SELECT n_nationkey, n_regionkey + 100 AS alt, n_name FROM nation)
SELECT k.k, coalesce(a.n_name, b.n_name) AS n_name FROM (SELECT unnest(range(0, 110)) AS k) k LEFT JOIN t a ON a.n_nationkey = k.k LEFT JOIN (SELECT alt, min(n_name) AS n_name FROM t GROUP BY 1) b ON b.alt = k.k""")
def two_way_lookup(table, spark, sf):
    nations = table("nation").select(F.col("n_nationkey").cast("long").alias("own"), (F.col("n_regionkey") + 100).cast("long").alias("alt"), "n_name")
    return Rp.lookup_either(spark.range(110).withColumnRenamed("id", "k"), nations, "k", ["own", "alt"], "n_name")


@query("""SELECT event_type, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS value, CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup', 'error') THEN sha256(user_id::VARCHAR) END AS user_id,
CASE WHEN event_type = 'error' THEN props END AS props FROM events""")
def public_ledger(table, spark, sf):
    kinds = {"click": ["value", "user_id"], "purchase": ["value", "user_id"], "view": ["user_id"], "signup": ["user_id"], "error": ["user_id", "props"]}
    return Rp.public_events(table("events"), kinds, "event_type", ["user_id"])


@query(r"""SELECT page_id FROM pages WHERE (regexp_matches(url, '^.*/en/.*$') OR regexp_matches(url, '^.*/fr/.*$')) AND NOT regexp_matches(url, '^(?:.*/)?[^/]*#top$')""")
def selected_paths(table, spark, sf):
    kept, _ = Rp.select_paths(table("pages"), ["**/en/**", "**/fr/**"], ["**/*#top"], "url")
    return kept.select("page_id")


@query("""SELECT name, used, cap FROM (SELECT 'clicks' AS name, count(*) FILTER (event_type = 'click') AS used, 100 AS cap FROM events UNION ALL SELECT 'views', count(*) FILTER (event_type = 'view'), 10000000 FROM events) WHERE used > cap""")
def budget_gate(table, spark, sf):
    n = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return Rp.over_budget(table("events").agg(n("click").alias("clicks"), n("view").alias("views")), {"clicks": 100, "views": 10_000_000})


@query("""SELECT avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS share, coalesce(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) > 0.2, false) AS dropped FROM labels""")
def arm_decision(table, spark, sf):
    return Rp.drop_arm(table("labels").select((F.col("toxic") == 1).alias("bad")), "bad")


@query("""SELECT p_partkey, md5('### Spec' || chr(10) || p_name || chr(10) || 'Fix {' || p_brand || '}: ' || p_size) AS prompt_md5 FROM part""")
def prompts_built(table, spark, sf):
    body = prompts.fill("{spec}Fix {{{brand}}}: {size}", spec=prompts.section("Spec", "p_name"), brand="p_brand", size="p_size")
    return table("part").select("p_partkey", F.md5(body).alias("prompt_md5"))


@query("""SELECT md5(text) AS text_md5, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1""")
def unique_documents(table, spark, sf):
    return G.duplicate_keys(table("documents").select(F.md5("text").alias("text_md5")), ["text_md5"])


@query("""SELECT l_orderkey, (SELECT avg(x) FROM (SELECT unnest(list_value(CASE WHEN l_orderkey % 2 = 0 THEN m END, v)) AS x)) AS derived FROM
(SELECT l_orderkey, avg(l_quantity) AS v, NULL::DOUBLE AS m FROM lineitem GROUP BY 1)""")
def derived_means(table, spark, sf):
    g = table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", Rp.scalar_or_mean(F.lit(None).cast("double"), F.col("q")).alias("derived"))

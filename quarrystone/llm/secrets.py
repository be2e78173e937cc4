r"""Operator 4, secret scans: strong patterns, and weak parts linked into credentials.

Native: DataFrame functions only.  Strong spans (assign, access, hex) stand on
their own.  Weak parts (an identifier, an opaque value, an endpoint) are reported
only when complementary parts lie within ``scope`` code points in the same text:
an interval join of the candidates, on bins as wide as the scope, so that each
candidate meets only its neighbours.  An opaque value needs an identifier, an
identifier needs a secret, an endpoint needs both.

Matches leave their text as rows (which text, kind, number, length of the piece before it, match);
their places are running sums over these rows, so that the work grows with the length of a text and
not with the square of its matches, and no text is moved.  A kind that a text does not hold costs one search.

Places are code points, end exclusive.  Defined results: null text is empty and has no spans; empty
texts have none; very long texts are scanned whole; equal rows get equal results, each its own row;
columns of the input may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, unwrapped, wrapped

#: The base patterns, with the group whose length counts and its least length.
BASE_KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # equal to a run of any length, then the test: a shorter run holds no longer one
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # likewise
]
WEAK_KINDS = [
    ("ident", r"(?i:user_?name|user_?id|client_?id|account_?id|key_?id|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", 0, 1),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    ("endpoint", r"https?://[^\x00-\x20\"'<>]{4,}", 0, 1),
]
ORDER = [k for k, *_ in BASE_KINDS + WEAK_KINDS]
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _match(rank: int, measured: str):
    return lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("m"), F.length(x[measured]).alias("size"))


def _matches(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank, i, gap, own, size, mixed: a row for each match of every pattern in text (twice for repeated rows)."""
    arrays = []
    for rank, (_, pattern, group, _least) in enumerate(BASE_KINDS + WEAK_KINDS):
        every = lambda g, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        zipped = F.arrays_zip(every(0).alias("m"), F.split("text", pattern, -1).alias("g"), *([every(group).alias("v")] if group else []))
        arrays.append(F.when(F.col("text").rlike(pattern), F.transform(zipped, _match(rank, "v" if group else "m"))).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,m:string,size:int>>")))
    found = df.select(*keys, F.explode(F.concat(*arrays)).alias("x")).where("x.m IS NOT NULL")
    mixed = F.col("x.m").rlike("[0-9]") & F.col("x.m").rlike("[A-Za-z]")
    return found.select(*keys, "x.rank", "x.i", "x.gap", F.length("x.m").alias("own"), "x.size", mixed.alias("mixed"))


def _spans(df: DataFrame) -> DataFrame:
    """k1, k2, rank, start, end of the matches that pass their tests, once for each text of df (text, k1, k2)."""
    keys = ["k1", "k2"]
    once = _matches(df, keys).repartition(*keys).groupBy(*keys, "rank", "i").agg(*[F.max(c).alias(c) for c in ("gap", "own", "size", "mixed")])
    before = W.partitionBy(*keys, "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(before).cast("int"))
    least = F.get(F.array(*[F.lit(k[3]) for k in BASE_KINDS + WEAK_KINDS]), F.col("rank"))
    # an opaque value has letters and digits
    kept = placed.where((F.col("size") >= least) & ((F.col("rank") != ORDER.index("opaque")) | F.col("mixed")))
    return kept.select(*keys, "rank", (F.col("end") - F.col("own")).alias("start"), "end")


def _show(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _free(spans: DataFrame) -> DataFrame:
    """spans without the weak ones that lie over a strong one: one that starts no later and has not ended, or starts within."""
    base = F.col("rank") < len(BASE_KINDS)
    of = W.partitionBy("k1", "k2")
    open_until = F.max(F.when(base, F.col("end"))).over(of.orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    next_start = F.min(F.when(base, F.col("start"))).over(of.orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, 0))
    marked = spans.withColumns({"_open": F.coalesce(open_until, F.lit(0)), "_next": F.coalesce(next_start, F.lit(2**31 - 1))})
    return marked.where(base | ((F.col("_open") <= F.col("start")) & (F.col("_next") >= F.col("end")))).drop("_open", "_next")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that complementary parts support."""
    role = F.get(F.array(*[F.lit(ROLE[k]) for k in ORDER]), F.col("rank"))
    spans = spans.withColumn("role", role).withColumn("bin", F.floor(F.col("start") / scope))
    left = spans.where(F.col("rank") >= len(BASE_KINDS)).withColumn("bin", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])))
    right = spans.select("k1", "k2", "bin", F.col("role").alias("o_role"), F.col("start").alias("o_start"))
    met = left.join(right, ["k1", "k2", "bin"]).where((F.abs(F.col("start") - F.col("o_start")) <= scope) & (F.col("role") != F.col("o_role")))
    has = lambda r: F.max(F.when(F.col("o_role") == r, True).otherwise(False))
    ok = F.when(F.col("role") == "secret", F.col("has_id")).when(F.col("role") == "id", F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return met.groupBy("k1", "k2", "rank", "start", "end", "role").agg(has("id").alias("has_id"), has("secret").alias("has_secret")).where(ok).select("k1", "k2", "rank", "start", "end")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with k1, k2: equal rows share them."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash("text", "doc_id"))


def all_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """k1, k2, rank, start, end: the strong spans and the supported weak ones of docs (text, k1, k2); rank is the place in ORDER."""
    spans = materialise(_free(_spans(docs.select("text", "k1", "k2"))), "spans")
    return spans.where(F.col("rank") < len(BASE_KINDS)).unionByName(_linked(spans, scope))


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """k1, k2, base, weak of the texts of docs (text, k1, k2) that have spans: arrays of struct(start, rank, end) in order."""
    every = all_spans(docs, scope).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    strong = lambda s: s["rank"] < len(BASE_KINDS)
    return every.select("k1", "k2", F.filter("all", strong).alias("base"), F.filter("all", lambda s: ~strong(s)).alias("weak"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.array().cast(SPAN)
    found = docs.select("doc_id", "k1", "k2").join(scan_secrets(docs), ["k1", "k2"], "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("weak", none).alias("weak"))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_show(F.col("base")), 256).alias("base_sha256"), _show(F.concat("base", "weak")).alias("spans"))


def redact(docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs with every reported span of text replaced by [REDACTED], overlapping spans by one; n_chars follows the text.

    Texts in which no pattern matches pass as they are; the others meet their spans.
    Null and empty texts stay; equal rows get equal texts; every column of docs is kept, whatever its name.
    """
    own = keyed(wrapped(docs, "doc_id", "text"))
    hit = F.coalesce(reduce(lambda a, b: a | b, [F.col("text").rlike(k[1]) for k in BASE_KINDS + WEAK_KINDS]), F.lit(False))
    # overlapping spans are one stretch: a span opens a new one if all before it have ended
    of = W.partitionBy("k1", "k2").orderBy("start", "end")
    ended = F.max("end").over(of.rowsBetween(W.unboundedPreceding, -1)) <= F.col("start")
    stretch = all_spans(own, scope).withColumn("new", F.coalesce(ended, F.lit(True)).cast("int")).withColumn("no", F.sum("new").over(of.rowsBetween(W.unboundedPreceding, 0)))
    stretch = stretch.groupBy("k1", "k2", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = stretch.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    found = own.where(hit).join(cuts, ["k1", "k2"], "left")
    sides = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("cuts.end")).alias("a"), F.concat(F.col("cuts.start"), F.array(F.length("text"))).alias("b"))
    kept = F.transform(sides, lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"]))
    found = found.withColumn("clean", F.when(F.col("cuts").isNotNull(), F.array_join(kept, "[REDACTED]")).otherwise(F.col("text")))
    replaced = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.col("cuts").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return unwrapped(own.where(~hit), docs.columns).unionByName(unwrapped(found, docs.columns, **replaced))


def _sql_places(kind: str, pattern: str, group: int, least: int) -> str:
    rank, p = ORDER.index(kind), pattern.replace("'", "''")
    size = f"length(regexp_extract_all(text, '{p}', {group})[i])"
    return f"""SELECT doc_id, k, {rank} AS rank, s AS start, s + length(m[i]) AS "end" FROM (
      SELECT doc_id, k, m, i, text, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT doc_id, k, text, m, string_split_regex(text, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, k, text, regexp_extract_all(text, '{p}') AS m FROM d) WHERE len(m) > 0)) WHERE {size} >= {least}""" + (
        f" AND regexp_matches(substr(text, s + 1, length(m[i])), '[0-9]') AND regexp_matches(substr(text, s + 1, length(m[i])), '[A-Za-z]')" if kind == "opaque" else ""
    )


_NAMES = "['" + "','".join(ORDER) + "']"
_ROLES = "['" + "','".join(ROLE[k] for k in ORDER) + "']"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
b AS ({reduce(lambda a, c: a + " UNION ALL " + c, [_sql_places(*k) for k in BASE_KINDS])}),
w0 AS ({reduce(lambda a, c: a + " UNION ALL " + c, [_sql_places(*k) for k in WEAK_KINDS])}),
w AS (SELECT * FROM w0 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = w0.k AND b.start < w0."end" AND w0.start < b."end")),
p AS (SELECT *, {_ROLES}[rank + 1] AS role FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
l AS (SELECT DISTINCT x.* FROM p x WHERE x.rank >= 3 AND CASE x.role
    WHEN 'secret' THEN EXISTS (SELECT 1 FROM p y WHERE y.k = x.k AND y.role = 'id' AND abs(y.start - x.start) <= 200)
    WHEN 'id' THEN EXISTS (SELECT 1 FROM p y WHERE y.k = x.k AND y.role = 'secret' AND abs(y.start - x.start) <= 200)
    ELSE EXISTS (SELECT 1 FROM p y WHERE y.k = x.k AND y.role = 'id' AND abs(y.start - x.start) <= 200)
     AND EXISTS (SELECT 1 FROM p y WHERE y.k = x.k AND y.role = 'secret' AND abs(y.start - x.start) <= 200) END),
a AS (SELECT k, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg({_NAMES}[rank + 1] || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (rank < 3) AS bs,
    string_agg({_NAMES}[rank + 1] || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS al
    FROM (SELECT k, rank, start, "end" FROM b UNION ALL SELECT k, rank, start, "end" FROM l) GROUP BY k)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans FROM d LEFT JOIN a ON a.k = d.k
"""

"""Equality of documents: every leaf of two JSON documents by its path, with tolerances for numbers.

A document is opened level by level with variant_explode, in one chain over one scan: a row that is no container stays as it is.
Two sides meet in one full outer join on document and path, so that missing, extra and changed leaves, leaves of another type and numbers
within their tolerance are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth_of(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested, those in strings aside."""
    bare = F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"|[^\[\]{}]', "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, type (object and array if empty, string, number, boolean, null, invalid) and value, as text, of every leaf.

    Paths have a / before each key or place; / and ~ in keys are written ~1 and ~0.  A text that is no JSON, or null, is one leaf.
    """
    depth = df.select(F.max(depth_of(F.col(json)))).first()[0] or 0
    rows = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(json).alias("v"))
    for _ in range(depth):
        inner = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).alias("x"))
        step = F.coalesce(F.replace(F.replace(F.col("x.key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("x.pos").cast("string"))
        name = F.when(F.col("x.pos").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("/"), step))
        rows = inner.select(rows["key"].alias("key"), name.alias("path"), F.when(F.col("x.pos").isNull(), F.col("v")).otherwise(F.col("x.value")).alias("v"))
    kind = F.schema_of_variant("v")
    named = F.when(F.col("v").isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    return rows.select(F.col("key").alias(key), "path", named.alias("type"), F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("value"))


def compared(a: DataFrame, b: DataFrame, key: str, json: str, tolerances: list[tuple[str, float, float]] = (), ignored: list[str] = ()) -> DataFrame:
    """key, path, type_a, value_a, type_b, value_b and status for every leaf of either side.

    status: 'equal', 'within' (numbers that differ by no more than the tolerance of their path), 'changed', 'type', 'missing' (in b)
    or 'extra'.  tolerances: pattern of paths, absolute, relative to the greater number; the first that fits counts.  Paths that a pattern
    of ignored finds are left out.
    """
    x = leaves(a, key, json).select(key, "path", F.col("type").alias("type_a"), F.col("value").alias("value_a"))
    y = leaves(b, key, json).select(key, "path", F.col("type").alias("type_b"), F.col("value").alias("value_b"))
    both = x.join(y, [key, "path"], "full")
    for pattern in ignored:
        both = both.where(~F.regexp_like("path", F.lit(pattern)))
    p, q = F.col("value_a").try_cast("double"), F.col("value_b").try_cast("double")
    most = F.greatest(F.abs(p), F.abs(q))
    allowed = F.lit(0.0)
    for pattern, absolute, relative in reversed(list(tolerances)):
        allowed = F.when(F.regexp_like("path", F.lit(pattern)), F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * most)).otherwise(allowed)
    numbers = (F.col("type_a") == "number") & (F.col("type_b") == "number")
    status = (
        F.when(F.col("type_b").isNull(), "missing").when(F.col("type_a").isNull(), "extra").when(F.col("type_a") != F.col("type_b"), "type")
        .when(F.col("value_a").eqNullSafe(F.col("value_b")) | (numbers & (p == q)), "equal").when(numbers & (F.abs(p - q) <= allowed), "within").otherwise("changed")
    )
    return both.select(key, "path", "type_a", "value_a", "type_b", "value_b", status.alias("status"))

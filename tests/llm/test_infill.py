"""Fill-in-middle against a plain version with the regex module of Python."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, marked string, n int")
    made = infill.transformed(df)
    got = made.select("doc.*", made.n.alias("units"), "form", F.length("prefix").alias("a"), F.length("middle").alias("b"), "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r["doc_id"], r["units"], r["form"], r["a"], r["b"], r["output"]) for r in got), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_awkward_texts(spark):
    """Delimiters, escapes and their stand-ins, marks and pieces of marks, astral code points, line ends, dollar signs and backslashes, nulls, repeated rows."""
    texts = [None, "", "a", "\x01", "\x02", "\x021\x01\x020\x02", "\x01\x01\x02\x020x\x01", "<P>", "a<S>b", "x<M", "<", "<P", "P> <S", "😀é́ ß\r\n\t$1 \\1 ab12cd", "x" * 50_000, "ab1" * 20_000, "\x01" * 3000, "\x020" * 3000, "\x00a\x00"]
    rows = [(i, t) for t in texts for i in (*range(40), None)]
    compare(spark, [*rows, *rows[:50]])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("aZ<>PSM\x01\x0201 é😀\n$\\"), max_size=30), min_size=1, max_size=60))
def test_any_texts(spark, texts):
    compare(spark, list(enumerate(texts)))


def test_all_forms_and_cuts_occur(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'one two three' as text")
    got = {(r["form"], r["prefix"] == "", r["suffix"] == "") for r in infill.transformed(df).select("form", "prefix", "suffix").distinct().collect()}
    assert {f for f, _, _ in got} == {"plain", "psm", "spm"} and ("psm", True, True) in got and ("psm", False, False) in got


def test_no_shuffle_and_no_python(spark, folder):
    df = spark.range(5).selectExpr("id as doc_id", "'x y' as text")
    plan = infill.op13_fill_in_middle(spark, folder(documents=df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

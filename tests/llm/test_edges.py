"""Every operator and stage over awkward and empty tables with clashing columns."""

import pytest

import corpus_pipeline
from quarrystone.llm import queries

BENCH = "item_id long, text string, extra string"
CONV = "conv_id long, turn long, role string, text string, formatted string"
VEC = "vec_id int, embedding array<float>, label int, ints string"


def tables(spark, docs, rows):
    bench = [(1, "nothing of this stands in any of the documents of the small table here at all", "x"), (None, "a b c d e f", None), (2, None, None), (3, "", None)] if rows else []
    conv = [(1, 0, "user", "hi", "f"), (1, 0, "user", "hi", "f"), (1, None, None, None, None), (None, 1, "assistant", "<|turn|>x<|end|>", "f"), (2, 1, "assistant", "", None)] if rows else []
    vec = [(1, [0.1] * 64, 1, "x"), (50, [0.1] * 64, 1, "x"), (2, None, None, None), (None, [], 0, None), (100, [None, float("nan"), 1.0] * 20, 1, "")] if rows else []
    return {"documents": docs, "benchmark": spark.createDataFrame(bench, BENCH), "conversations": spark.createDataFrame(conv, CONV), "embeddings": spark.createDataFrame(vec, VEC)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_takes_awkward_rows(spark, awkward, awkward_rows, folder, name):
    got = queries.QUERIES[name](spark, folder(**tables(spark, awkward, True))).collect()
    if name.startswith(("op3_", "op4_", "op6_", "op7_", "op8_", "op9_", "op10_")):
        key = lambda x: (x is None, x)
        assert sorted([r["doc_id"] for r in got], key=key) == sorted([r[0] for r in awkward_rows], key=key)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_takes_empty_tables(spark, empty, folder, name):
    got = queries.QUERIES[name](spark, folder(**tables(spark, empty, False))).collect()
    assert len(got) == (1 if name.startswith("op1_") else 0)


def test_stages_take_awkward_rows(spark, awkward, folder):
    sf = folder(**tables(spark, awkward, True))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
    got = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert 1 in got and 7 in got and not {2, 3, 4, 6} & set(got)


def test_stages_take_an_empty_table(spark, empty, folder):
    sf = folder(**tables(spark, empty, False))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_language_stage_keeps_texts_where_nothing_is_labelled(spark, awkward, awkward_rows, folder):
    from pyspark.sql import functions as F

    sf = folder(**tables(spark, awkward.withColumn("lang", F.lit(None).cast("string")), True))
    got = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in awkward_rows if r[1] and any(c.isalpha() for c in r[1]))
    assert {r["lang_pred"] for r in queries.QUERIES["op10_language_id"](spark, sf).collect()} == {"und"}


def test_values_on_awkward_rows(spark, awkward, awkward_rows, folder):
    """What each query says of null, empty, blank, very long and repeated texts."""
    import re
    from collections import Counter

    from tokenizers import Tokenizer

    from quarrystone.llm import bpe
    from tests.llm.test_operators import brute_substring

    sf = folder(**tables(spark, awkward, True))
    rows = [(r[0], r[1]) for r in awkward_rows]
    run = lambda name: queries.QUERIES[name](spark, sf).collect()
    lib = Tokenizer.from_file(bpe.default_path())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in run("op6_bpe_encode")) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    got = run("op7_lm_score")
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(w) + 1) for i, w in words) and all(r["score"] < 0 for r in got)
    named = [(i, t or "") for i, t in rows if i is not None]
    want = brute_substring(named)
    got = [r for r in run("op3_substring_dedup") if r["doc_id"] is not None]
    assert all(r["n_removed"] == want[r["doc_id"]][1] for r in got if r["doc_id"] != 5) and all(r["n_removed"] == 0 for r in got if r["doc_id"] == 5)
    for r in run("op10_language_id"):
        if r["doc_id"] in (2, 3, 4, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["doc_id"]: r["class_id"] for r in run("op9_near_dedup") if r["doc_id"] in (2, 3, 4, 5, 8)} == {2: 2, 3: 3, 4: 4, 5: 5, 8: 8}
    spans = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in run("op4_secret_scan")}
    assert spans[9] == (1, 1, 1) and spans[2] == spans[3] == spans[8] == (0, 0, 0)
    licenses = {(r["doc_id"], r["n_words"], r["score"]) for r in run("op8_license_scan") if r["doc_id"] in (2, 3, 4, 8)}
    assert licenses == {(2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0), (8, 1, 0.0)}
    assert not run("op2_decontamination")

"""The pipeline against a plain version of each stage."""

import hashlib
import os

import duckdb
import numpy as np

import corpus_pipeline
from quarrystone.llm import bagminhash, bpe, decontam, langid, secrets
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = [d for d in docs if not langid.predict(model, d[1])[2]]
    classes = brute_classes([(d[0], d[1]) for d in kept])
    kept = [d for d in kept if classes[d[0]] == d[0]]
    bench_words = [decontam.plain_words(t) for _, t in bench]

    def leaks(text):
        w = decontam.plain_words(text)
        grams = {tuple(w[p : p + 13]) for p in range(len(w) - 12)}
        return any(tuple(b[p : p + 13]) in grams for b in bench_words for p in range(len(b) - 12))

    kept = [d for d in kept if not leaks(d[1])]
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame([d[:2] for d in kept], "doc_id long, text string")).collect()}
    lib = Tokenizer.from_file(bpe.default_path())
    want = {}
    for doc_id, _, lang, source in kept:
        ids = lib.encode(cleaned[doc_id], add_special_tokens=False).ids
        want[doc_id] = (lang, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["lang"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in got} == want
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in got) and len(got) < len(docs)


def test_stage_keeps_one_of_each_class(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "x"), (2, "a b c d e f g h", "x"), (3, "other words stand in this one here", "x"), (3, "other words stand in this one here", "x")]
    got = bagminhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]


def test_stage_keeps_one_of_each_class_without_ids(spark):
    """Near copies without an id, copies of documents with one, and rows without words."""
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"other{k}"])
    lone = [f"v{i}" for i in range(60)]
    rows = [(1, near(0)), (None, near(1)), (None, near(0)), (None, " ".join(lone)), (None, " ".join([*lone[:-1], "last"])), (None, None), (None, ""), (None, " "), (None, None)]
    rows += [(2, near(2)), (2, "a text of its own under the same number")]
    got = [tuple(r) for r in bagminhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len([t for i, t in got if t and t.startswith("v0")]) == 1
    rest = sorted((str(i), str(t)) for i, t in got if not (t and t.startswith("v0")))
    assert rest == sorted([("1", near(0)), ("2", "a text of its own under the same number"), ("None", "None"), ("None", "None"), ("None", ""), ("None", " ")])


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)

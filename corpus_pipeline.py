"""The training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir), with docs in the columns of documents, and
returns a DataFrame that is written and read again as the next one's docs.

Defined results of every stage: an empty table gives no rows; every column of docs is carried, whatever its name
(the last stage keeps doc_id, lang and source); very long texts are taken whole.  Rows with null or empty texts
have no letter, so the first stage drops them; the stages after it keep them if they are given some.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import bagminhash, bpe, decontam, langid, secrets
from quarrystone.llm.common import shared_dir, table, unwrapped, wrapped


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: those without a letter or with an unsure answer.

    Equal rows fall or stay together.  Where no document has a label, there is no language to be sure of: only those without a letter go.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(wrapped(docs), model, ["doc"])
    return unwrapped(named.where(~F.col("rejected")), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that with the least doc_id, a null one only if none has an id.

    Of rows equal in doc_id and text the one with the least hash of all columns stays; rows without words are a class each.
    """
    return bagminhash.one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item; an empty benchmark drops none, and equal rows fall or stay together."""
    found = decontam.find_overlaps(wrapped(docs), table(spark, sf_dir, "benchmark"), ["doc"])
    return unwrapped(found.where(F.size("found") == 0), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and linked credential parts in the texts; n_chars follows the text.  Equal rows get equal texts; null texts stay null."""
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of ids and of their decoding, and the ids; null and empty texts have no tokens, and every row stays."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.encode(docs, bpe.default_path(), keep, ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("bpe_encode", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: BPE encoding can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

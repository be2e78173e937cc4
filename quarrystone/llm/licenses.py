"""Operator 8, license scans: diagonal voting.

All rolling hashes of three words of every text are joined in Spark to the positions of
the same hashes in a fixed set of license templates (``license_texts``; any others can be
given).  Hits are counted by text, template and offset (the diagonal: place in the text less
place in the template); neighbouring diagonals of neighbouring places are merged, so that
inserted or dropped words do not split a match; a merged match is verified by the
longest chain of its hits that runs forward in the text and in the template, as the share of the
template's words under it.

Equal texts are one text while votes are counted; their key is a hash of the raw text, so that a
repeated task makes the same rows, and votes of copies are merged before they are shuffled.

Words are runs of letters, digits and anything outside ASCII, A-Z as a-z.  Beside that, the
base counts the places of four fixed phrases.

Defined results: null and empty text have no words, no labels and score 0; very long texts are
scanned whole; equal rows get equal results (each row its own); of several matches with one template the best
counts; columns of docs may have any names but those of the result; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, rolling, schema_with, table, texts_of, with_text, word_hashes
from .license_texts import TEMPLATES

#: Base phrases and labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
GRAM = 3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def base_places(words: list[bytes]) -> tuple[list[int], list[str]]:
    """Word places and labels of the base phrases, by a search in the joined words."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES:
        key = b" " + phrase.encode() + b" "
        at, seen, word = line.find(key), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            places.append(word)
            labels.add(label)
            at = line.find(key, at + 1)
    return places, sorted(labels)


#: Characters of all templates that are broadcast; more are joined by shuffling.
BROADCAST = 10_000_000


def template_positions(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, t_label, t_words, t_pos, gram: a row for each of the templates' words."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = license_words(text)
        rows += [(i, label, len(words), p, int(g)) for p, g in enumerate(rolling(word_hashes(words), GRAM).view(np.int64))]
    return spark.createDataFrame(rows, "template int, t_label string, t_words int, t_pos int, gram long")


def forward_cover(hits: list[tuple[int, int]]) -> int:
    """Words of the template under the longest chain of hits (place in the text, place in the template) that runs forward in both."""
    ends, best, back = [], [], []  # of chains by length: last template place, and its hit
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))  # of one place in the text one hit at most
    for n, (_, t) in enumerate(hits):
        k = bisect.bisect_left(ends, t)
        back.append(best[k - 1] if k else -1)
        ends[k : k + 1], best[k : k + 1] = [t], [n]
    chain, n = [], best[-1] if best else -1
    while n >= 0:
        chain.append(hits[n][1])
        n = back[n]
    return sum(min(GRAM, later - t) for later, t in zip([chain[0] + GRAM, *chain], chain)) if chain else 0


def _key(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _grams(texts: DataFrame) -> DataFrame:
    """k1, k2, pos, gram of every place of texts (k1, k2, _text)."""

    def run(batch: pa.RecordBatch):
        got = [rolling(word_hashes(license_words(t)), GRAM).view(np.int64) for t in batch.column("_text").to_pylist()]
        n = [len(g) for g in got]
        row = np.repeat(np.arange(len(got)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum([0, *n[:-1]]), n)
        yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(row)), batch.column("k2").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(np.concatenate(got))], names=["k1", "k2", "pos", "gram"])

    return texts.mapInArrow(batches(run), "k1 long, k2 int, pos int, gram long")


def matches(docs: DataFrame, templates: list[tuple[str, str]], drift: int) -> DataFrame:
    """k1, k2, label, share: the verified matches of the texts of docs (_text) with templates."""
    texts = docs.where(F.length("_text") > 0).select(*_key(F.col("_text")), "_text")
    known = template_positions(docs.sparkSession, templates)  # as many rows as the templates have words
    if sum(len(text) for _, text in templates) <= BROADCAST:
        known = F.broadcast(known)
    hits = _grams(texts).join(known, "gram")
    votes = hits.groupBy("k1", "k2", "template", "t_label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.collect_set("t_pos").alias("at"))
    order = W.partitionBy("k1", "k2", "template").orderBy("diagonal", "start")
    new = F.when((F.col("diagonal") - F.lag("diagonal").over(order) <= drift) & (F.col("start") - F.lag("end").over(order) <= F.col("t_words")), 0).otherwise(1)
    merged = votes.withColumn("match", F.sum(new).over(order)).groupBy("k1", "k2", "template", "t_label", "t_words", "match").agg(F.collect_list(F.struct("diagonal", "at")).alias("hits"))

    @F.pandas_udf("int")
    def covered(column: pd.Series) -> pd.Series:
        return pd.Series([forward_cover([(h["diagonal"] + t, t) for h in hits for t in h["at"]]) for hits in column])

    return merged.select("k1", "k2", F.col("t_label").alias("label"), F.least(F.lit(1.0), covered("hits") / F.col("t_words")).alias("share"))


def scan(docs: DataFrame, keep: list[str], coverage: float = 0.8, drift: int = 2, templates: list[tuple[str, str]] | None = None, salts: int = 16) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (text)."""
    schema = schema_with(docs, keep, "k1 long, k2 int, salt int, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")

    def run(batch: pa.RecordBatch):
        out = []
        for text in texts_of(batch):
            words = license_words(text)
            places, labels = base_places(words)
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), labels))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keep, "k1", "k2", "salt"]], *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=schema.names)

    text = with_text(docs, keep)
    source = F.col("text") if "text" in keep else F.col("doc.text") if "doc" in keep else F.col("_text")
    rows = text.select("*", *_key(source), F.pmod(F.xxhash64(*keep), F.lit(salts)).cast("int").alias("salt")).mapInArrow(batches(run), schema)
    found = matches(text.select(source.alias("_text")), templates or TEMPLATES, drift)
    own = found.groupBy("k1", "k2").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= coverage, F.col("label"))).alias("own"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # a text that many rows have meets them in several tasks
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    both = rows.join(own, ["k1", "k2", "salt"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    return both.select(*keep, "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(F.array_union("base_labels", "own")).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

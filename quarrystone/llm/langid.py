"""Operator 10, language ID: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of the lower-cased text are hashed to buckets, each with a small
vector; a text is the mean of its vectors, and a linear softmax names the language.
Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents: on their whole texts, as bucket counts, and on pieces of many lengths from anywhere in them, both made where
the texts are, so that what is gathered is bounded however long they are.  It is calibrated on documents that the descent has not
seen: by a temperature on their pieces, and by a cut, the least probability from ``floor`` on
above which ``precision`` of their whole texts are named rightly.  A text is rejected if it has no letter or
if its calibrated probability is below the cut.

After training, bucket vectors and softmax weights collapse into one table of scores,
so that a prediction counts the buckets of the whole text and multiplies once.

Defined results: null text, empty text and text without a letter give ``und``, 0.0 and
rejected; labels that are null are not learned; equal rows get equal results; an empty
table gives no rows; with nothing to learn from, every text is ``und``; very long texts are counted
whole; columns of docs may have any names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, texts_of, with_text

LETTER = regex.compile(r"\p{L}")
SIZES = (1, 2, 3, 4)
BITS = 15
#: Pieces of a text that are learned from, those that calibrate, and of how many bytes all are: from 8 to 8 times as many as this.
PIECES, SHORT, LONG = 24, 8, 80


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float
    reject_below: float


def buckets_of(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, 2166136261 + n, np.uint32)
        for j in range(n):
            h ^= b[j : j + len(h)]
            h *= np.uint32(16777619)
        out.append((h ^ (h >> np.uint32(15))) & np.uint32((1 << BITS) - 1))
    return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Lesson(NamedTuple):
    """A labelled text: pieces, the last two for calibration, and how often each bucket occurs in all of it, packed: the driver holds many and looks at few at a time."""

    label: str
    pieces: list[bytes]
    packed: bytes

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all of the text and their counts."""
        data = zlib.decompress(self.packed)
        n = len(data) // 10
        return np.cumsum(np.frombuffer(data, "<u2", n), dtype=np.int64), np.frombuffer(data, "<i8", n, 2 * n)

    @property
    def counts(self) -> np.ndarray:
        return self.whole()[1]


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets as steps, then counts: both small numbers, a tenth of their arrays' size or so."""
    return zlib.compress(np.diff(buckets, prepend=0).astype("<u2").tobytes() + counts.astype("<i8").tobytes(), 1)


def lesson(label: str, text: str) -> Lesson:
    data = text.lower().encode("utf-8", "replace")
    rng = np.random.default_rng(xxhash.xxh64_intdigest(data))
    pieces = []
    for longest in [LONG] * PIECES + [SHORT, LONG]:
        n = int(longest ** rng.random() * 8)
        at = int(rng.integers(0, max(1, len(data) - n + 1)))
        pieces.append(data[at : at + n])
    buckets, counts = np.unique(buckets_of(data), return_counts=True)
    return Lesson(label, pieces, packed(buckets.astype(np.int64), counts))


def train(rows: list[Lesson], dim: int = 16, steps: int = 12_000, rate: float = 0.5, floor: float = 0.5, precision: float = 0.98, seed: int = 7) -> Model | None:
    """rows: in a fixed order.  One step of eight takes a whole text, the others a piece."""
    labels = sorted({r.label for r in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    of = {y: k for k, y in enumerate(labels)}
    held = [r for i, r in enumerate(rows) if i % 5 == 0] or rows
    used = [r for i, r in enumerate(rows) if i % 5] or rows
    by_label: list[list[Lesson]] = [[] for _ in labels]
    for r in used:
        by_label[of[r.label]].append(r)
    for k, own in enumerate(by_label):
        own += [] if own else [r for r in rows if of[r.label] == k]
    vectors = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)

    for step in range(steps):
        k = int(rng.integers(len(labels)))
        r = by_label[k][int(rng.integers(len(by_label[k])))]
        if step % 8:
            idx = buckets_of(r.pieces[int(rng.integers(PIECES))])
            share = np.full(len(idx), 1 / len(idx), np.float32)
        else:
            idx, counts = r.whole()
            share = (counts / counts.sum()).astype(np.float32)
        mean = share @ vectors[idx]
        error = _softmax(mean @ weights + bias)
        error[k] -= 1
        lr = rate * (1 - step / steps)
        back = weights @ error
        weights -= lr * np.outer(mean, error)
        bias -= 0.1 * lr * error
        np.subtract.at(vectors, idx, 20 * lr * share[:, None] * back)
    scores = (vectors @ weights).astype(np.float64)
    bias = bias.astype(np.float64)
    logits, truth = [], []
    for r in held:
        for piece in r.pieces[PIECES:]:
            logits.append(scores[buckets_of(piece)].mean(axis=0) + bias)
            truth.append(of[r.label])
    logits, truth = np.array(logits), np.array(truth)
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    whole = np.array([counts @ scores[idx] / counts.sum() for idx, counts in (r.whole() for r in held)]) + bias
    return Model(labels, scores, bias, temperature, cut_at(_softmax(whole / temperature), np.array([of[r.label] for r in held]), floor, precision))


def cut_at(p: np.ndarray, truth: np.ndarray, floor: float, precision: float) -> float:
    """The least probability from floor on at and above which the named label is right in the share precision; 0.9 if there is none."""
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    lowest = float(best[order][good[-1]]) if len(good) else 0.9
    return max(floor, min(lowest, 0.9))


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    if model is None or not text or not LETTER.search(text):
        return "und", 0.0, True
    idx = buckets_of(text.lower().encode("utf-8", "replace"))
    count = np.bincount(idx, minlength=1 << BITS)
    if len(idx) < 4096:
        z = model.scores[idx].mean(axis=0)
    else:
        z = count @ model.scores / len(idx)
    p = _softmax((z + model.bias) / model.temperature)
    k = int(np.argmax(p))
    return model.labels[k], float(p[k]), bool(p[k] < model.reject_below)


def labelled_sample(docs: DataFrame, per_class: int = 400, most_rows: int = 200_000) -> list[Lesson]:
    """At most per_class labelled texts with a letter of each language, chosen by a hash of the row: bounded, and the same at every run.

    Counts first (from lang alone), then one filtered read; equal rows count once.  With more than most_rows / per_class languages each has
    as many fewer, one at least.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return []
    each = max(1, min(per_class, most_rows // len(sizes)))
    mark = F.xxhash64("doc_id", "text")
    share = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, 1.2 * each / n + 10 / n))])
    picked = known.where(share <= F.element_at(limit, F.col("lang"))).groupBy("lang", mark.alias("mark")).agg(F.min("text").alias("text"))
    first = picked.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark"))).where(F.col("n") <= each)

    def run(batch: pa.RecordBatch):
        made = [lesson(y, t) for y, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        arrays = [batch.column("lang"), batch.column("n"), pa.array([m.pieces for m in made], pa.list_(pa.binary())), pa.array([m.packed for m in made], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "pieces", "packed"])

    lessons = first.select("lang", "n", "text").mapInArrow(batches(run), "lang string, n int, pieces array<binary>, packed binary").toArrow()
    rows = sorted(lessons.to_pylist(), key=lambda r: (r["lang"], r["n"]))
    return [Lesson(r["lang"], r["pieces"], r["packed"]) for r in rows]


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with lang_pred, score and rejected from text."""
    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batch: pa.RecordBatch):
        got = [predict(shared.value, t) for t in texts_of(batch)]
        cols = [batch.column(k) for k in keep]
        cols += [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return with_text(docs, keep).mapInArrow(batches(run), schema)


def in_fold(doc_id, folds: int):
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the text 'None'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("None"))) % folds


def fit(docs: DataFrame, per_class: int = 400) -> Model | None:
    """Learns from the documents outside the held-out fold."""
    return train(labelled_sample(docs.where(in_fold(F.col("doc_id"), 5) != 0).select("doc_id", "lang", "text"), per_class))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = identify(docs.select("doc_id", "text"), fit(docs), ["doc_id"])
    return made.select("doc_id", (in_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")

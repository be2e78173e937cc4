"""Operator 2, benchmark decontamination: spaced-seed hashing.

Fixed masks of 9 or 10 words ignore some of their positions.  The hashes of a mask's
words are joined between benchmark items and documents, so that a substituted word
that falls on an ignored position does not hide the overlap.  Any 13 words of which two are
substituted hold a hit.  Items shorter than that are cut in one piece more than substitutions are
allowed, so that one piece is whole: none of their overlaps is missed.

The two texts are compared along each hit's diagonal: every stretch is reported that has ``least`` words or the
whole item and of whose words at least ``similarity`` agree, less unequal words at its ends, the longest
first, if no longer one of the same item lies over its words.  Words are letters and digits, in lower case, so that case and
punctuation do not matter.

A benchmark of up to ``block_chars`` characters is broadcast as sorted hashes.  A larger one is joined in
Spark: its seeds with those of the distinct texts, then the texts and items of the hits' diagonals.

Defined results: null or empty texts (documents or items) overlap with nothing; items of fewer than
``shortest`` words are left out (none by default: an item of one word is found wherever the word stands); of two stretches of the same length the first counts; very long texts are
compared whole; repeated rows are reported each; an empty table on either side gives no rows; columns of docs may have any names but found.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, rolling, texts_of, with_text, word_hashes

#: Fixed masks: 1 counts, 0 is ignored.  Any stretch of 13 words with two substitutions holds a hit of one of them.
MASKS = ("110100111", "111001011", "1100110101", "1011001011")
SURE = 13
SALT = 1000  # places of a seed in items that one task joins with the texts that have it
_PLAIN = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def masked(h: np.ndarray, no: int) -> np.ndarray:
    """A mask's hashes; from number len(MASKS) on pieces of 1, 2, ... words."""
    if no >= len(MASKS):
        return rolling(h, no - len(MASKS) + 1) + np.uint64(no)
    mask = MASKS[no]
    return rolling(h, len(mask), tuple(i for i, c in enumerate(mask) if c == "1")) + np.uint64(no)


def item_seeds(h: np.ndarray, similarity: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, hashes, places) of an item: all of every mask, or the pieces of a short one."""
    if len(h) >= SURE:
        return [(no, x, np.arange(len(x))) for no in range(len(MASKS)) for x in [masked(h, no)]]
    edges = np.linspace(0, len(h), int((1 - similarity) * len(h) + 1e-9) + 2).round().astype(int)
    return [(len(MASKS) + b - a - 1, masked(h[a:b], len(MASKS) + b - a - 1), np.array([a])) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


class Seeds:
    """Seed hashes of a bounded benchmark, with a bit table that answers most misses."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, shortest: int = 1):
        hashed = [(i, word_hashes(plain_words(t))) for i, t in items]
        self.items = [(i, h) for i, h in hashed if len(h) >= max(1, shortest)]
        made: dict[int, list] = {}
        for n, (_, h) in enumerate(self.items):
            for no, x, at in item_seeds(h, similarity):
                made.setdefault(no, []).append((x, np.full(len(x), n, np.int32), at.astype(np.int32)))
        self.tables = {}
        for no, rows in sorted(made.items()):
            keys, item, at = map(np.concatenate, zip(*rows, strict=True))
            order = np.lexsort((at, item, keys))
            bits = np.zeros(1 << 20, bool)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[no] = bits, keys[order], item[order], at[order]

    def hits(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, diagonal) of every hit in a document."""
        found = []
        for no, (bits, keys, item, at) in self.tables.items():
            m = masked(h, no)
            near = np.flatnonzero(bits[(m >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(keys, m[near]), np.searchsorted(keys, m[near], "right")
            near, low, n = near[high > low], low[high > low], (high - low)[high > low]
            row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(np.stack([item[row], np.repeat(near, n) - at[row]]), axis=1) if len(row) else np.empty((2, 0), np.int64))
        return [tuple(x) for x in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()] if found else []


def stretch(same: np.ndarray, least: int, similarity: float) -> tuple[int, int, int] | None:
    """start, end, equal places of the longest stretch (the first of several) of at least ``least`` places of which similarity are equal.

    Such a stretch can be cut to equal ends unless that makes it too short; one that can't is taken as it is.
    """
    sums = np.concatenate([[0], np.cumsum(same)])
    gain = sums - similarity * np.arange(len(sums))
    lows = np.minimum.accumulate(gain)  # for each end, the first start that is low enough
    ends = np.arange(least, len(sums))
    starts = np.searchsorted(-lows, -(gain[least:] + 1e-9))
    length = ends - starts
    if not len(ends) or length.max() < least:
        return None
    end = int(ends[length.argmax()])
    start = end - int(length.max())
    while end - start > least and not same[start]:
        start += 1
    while end - start > least and not same[end - 1]:
        end -= 1
    return start, end, int(sums[end] - sums[start])


def on_diagonal(h: np.ndarray, own: np.ndarray, diagonal: int, least: int, similarity: float) -> list[tuple[int, int, int]]:
    """start, end (in the document), equal words of the stretches on a diagonal: the longest, then those beside it."""
    low, high = max(0, diagonal), min(len(h), diagonal + len(own))
    same, out, todo = h[low:high] == own[low - diagonal : high - diagonal], [], [(0, high - low)]
    while todo:
        i, j = todo.pop()
        got = stretch(same[i:j], min(least, len(own)), similarity)
        if got:
            start, end, equal = got
            out.append((low + i + start, low + i + end, equal))
            todo += [(i, i + start), (i + end, j)]
    return out


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (equal, start, end, diagonal) those that no better one lies over."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    for row in sorted(found, key=lambda r: (-r[0], r[1], r[2])):
        at = bisect.bisect_left(starts, row[1])
        if (at == 0 or kept[at - 1][2] <= row[1]) and (at == len(kept) or starts[at] >= row[2]):
            kept.insert(at, row)
            starts.insert(at, row[1])
    return kept


def overlaps(seeds: Seeds, text: str | None, least: int, similarity: float) -> list[tuple]:
    """(item_id, start, end, item_start, equal words) of every verified stretch with each item."""
    h = word_hashes(plain_words(text))
    found: dict[int, list] = {}
    for n, diagonal in seeds.hits(h):
        found.setdefault(n, []).extend((q, s, e, diagonal) for s, e, q in on_diagonal(h, seeds.items[n][1], diagonal, least, similarity))
    return [(seeds.items[n][0], s, e, s - d, q) for n, rows in sorted(found.items()) for q, s, e, d in apart(rows)]


FOUND = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("item_id", "start", "end", "item_start", "equal")]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], least: int = 13, similarity: float = 0.8, shortest: int = 1, block_chars: int = 8_000_000) -> DataFrame:
    """keep and found (the verified overlaps with items) for each row of docs."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    made = with_text(docs, keep)
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars:
        return _joined(made, items, keep, least, similarity, shortest)
    shared = spark.sparkContext.broadcast(Seeds(sorted((r["item_id"], r["text"]) for r in items.collect()), similarity, shortest))
    schema, carried = made.withColumn("found", F.array().cast(FOUND)).schema, made.columns

    def run(batch: pa.RecordBatch):
        got = [[dict(zip(FOUND.elementType.names, o, strict=True)) for o in overlaps(shared.value, t, least, similarity)] for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in carried], pa.array(got, KIND)], names=schema.names)

    return made.mapInArrow(batches(run), schema).select(*keep, "found")


KIND = pa.list_(pa.struct([(k, pa.int64()) for k in FOUND.elementType.names]))


def _joined(made: DataFrame, items: DataFrame, keep: list[str], least: int, similarity: float, shortest: int) -> DataFrame:
    """find_overlaps() for a benchmark of any size: seeds are rows, and equal texts are one."""
    text = F.col("text") if "text" in keep else F.col("doc.text") if "doc" in keep else F.col("_text")
    key = [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]
    texts = materialise(made.where(F.length(text) > 0).select(*key, text.alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text")), "texts")
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("item", F.xxhash64("item_id", "text"))

    def of_items(batch: pa.RecordBatch):
        for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            h = word_hashes(plain_words(t))
            for no, x, at in item_seeds(h, similarity) if len(h) >= max(1, shortest) else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(np.full(len(x), no, np.int32)), pa.array(x.view(np.int64)), pa.array(at.astype(np.int32))], names=["item", "no", "x", "at"])

    seeds = materialise(items.mapInArrow(batches(of_items), "item long, no int, x long, at int"), "seeds")
    numbers = sorted(r["no"] for r in seeds.select("no").distinct().collect())  # a few masks and lengths of pieces

    def of_texts(batch: pa.RecordBatch):
        for i, t in enumerate(batch.column("text").to_pylist()):
            h = word_hashes(plain_words(t))
            for no in numbers:
                x = masked(h, no)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array([i] * len(x), pa.int32())), batch.column("k2").take(pa.array([i] * len(x), pa.int32())), pa.array(np.full(len(x), no, np.int32)), pa.array(x.view(np.int64)), pa.array(np.arange(len(x), dtype=np.int32))], names=["k1", "k2", "no", "x", "pos"])

    # a seed that many items have is dealt over tasks, and a text with it is told to each
    sizes = materialise(seeds.groupBy("no", "x").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts")), "sizes")
    salted = seeds.join(sizes, ["no", "x"]).withColumn("salt", F.pmod(F.xxhash64("item", "at"), F.col("salts"))).drop("salts")
    told = texts.mapInArrow(batches(of_texts), "k1 long, k2 int, no int, x long, pos int").join(sizes, ["no", "x"])
    hits = told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).join(salted, ["no", "x", "salt"])
    hits = hits.select("k1", "k2", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    pairs = hits.groupBy("k1", "k2", "item").agg(F.collect_set("diagonal").alias("diagonals")).join(texts, ["k1", "k2"]).join(items.select("item", "item_id", "times", F.col("text").alias("own")), "item")
    kind = T.StructType([*[T.StructField(k, T.LongType()) for k in ("k1", "times")], T.StructField("k2", T.IntegerType()), *FOUND.elementType.fields])

    def verify(batch: pa.RecordBatch):
        out = []
        for r in batch.select(["k1", "k2", "times", "item_id", "diagonals", "text", "own"]).to_pylist():
            h, own = word_hashes(plain_words(r["text"])), word_hashes(plain_words(r["own"]))
            rows = apart([(q, s, e, d) for d in r["diagonals"] for s, e, q in on_diagonal(h, own, d, least, similarity)])
            out += [(r["k1"], r["times"], r["k2"], r["item_id"], s, e, s - d, q) for q, s, e, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32() if f.dataType == T.IntegerType() else pa.int64()) for i, f in enumerate(kind.fields)], names=kind.names)

    found = pairs.mapInArrow(batches(verify), kind).groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(named_struct('item_id', item_id, 'start', start, 'end', end, 'item_start', item_start, 'equal', equal), int(times))")))).cast(FOUND).alias("found"))
    return made.select("*", *key).join(found, ["k1", "k2"], "left").select(*keep, F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap: places in words, end exclusive."""
    from .common import table

    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    rows = found.select("doc_id", F.explode("found").alias("o")).select("doc_id", "o.*")
    return rows.select("doc_id", "item_id", F.col("start").alias("doc_start"), F.col("end").alias("doc_end"), "item_start", F.col("equal").alias("n_equal"), (F.col("equal") / (F.col("end") - F.col("start"))).alias("similarity"))

"""Operator 5, media columns: chroma audio fingerprints.

A recording's samples become frames of twelve pitch classes.  Sixteen filters, each a
difference of rectangles read from an integral image over time and pitch class, give two
bits each, so that every frame has a packed 32-bit integer.  Two recordings are aligned at
every offset at once: the 32 bits are correlated by Fourier transforms, which gives agreeing
less differing bits of each overlap.  Of the offsets with few differing bits the one with
most agreeing less differing bits is reported (of equal ones the nearest).

Recordings with the same fingerprint are one class; searches run between classes, of which
the query set is those that hold a queried recording, against all classes, dealt in chunks
of both.

Defined results: null and too short recordings have an empty fingerprint, are each a
class of their own and match nothing; silence has a constant fingerprint and is a class like
any other; repeated rows fall in one class; of equal alignments the nearest offset counts; very long recordings are
taken whole, fewer at once; columns of the input may have any names but ints; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, schema_with, table

RATE, FRAME, HOP, LOWEST = 4096, 1024, 256, 110.0
SPAN = 16  # frames under the widest filter
QUERIES, OTHERS = 512, 2048  # recordings in a chunk


def filters() -> list[tuple[int, int, int, int]]:
    """kind, first pitch class, height, width of each of the 16 filters, by a rule that spreads them."""
    out = []
    for i in range(16):
        height = 2 + (7 * i) % 11
        out.append((i % 6, (3 * i) % (13 - height), height, 4 + 2 * ((5 * i) % 7)))
    return out


def read_pcm(cell: bytes | None) -> np.ndarray:
    """16-bit little-endian mono samples at RATE."""
    return np.frombuffer(cell[: len(cell) // 2 * 2], "<i2").astype(np.float32) / 32768 if cell else np.empty(0, np.float32)


def tones(cell: list | None, samples: int = 512) -> np.ndarray:
    """A recording of one tone for each number: its pitch, of 36 semitones from 220 Hz, follows the number, as a share of their root mean square."""
    if not cell:
        return np.empty(0, np.float32)
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in cell], float))
    v = v / (np.sqrt(np.mean(v * v)) or 1.0)
    note = np.clip(np.floor((np.tanh(v) + 1) * 18), 0, 35)
    t = np.arange(samples, dtype=np.float32) / RATE
    return (0.5 * np.sin(2 * np.pi * (220 * 2 ** (note / 12))[:, None].astype(np.float32) * t)).astype(np.float32).ravel()


@lru_cache(maxsize=1)
def _analysis() -> tuple[np.ndarray, slice, np.ndarray]:
    """The window, the frequencies in use, and the pitch class of each of them."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= LOWEST) & (hz <= RATE * 0.45))
    fold = np.zeros((len(used), 12), np.float32)
    fold[np.arange(len(used)), np.round(12 * np.log2(hz[used] / LOWEST)).astype(int) % 12] = 1
    return np.hanning(FRAME).astype(np.float32), slice(used[0], used[-1] + 1), fold


def pitch_classes(samples: np.ndarray) -> np.ndarray:
    """frames x 12, each row of length 1 (or 0 in silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.empty((0, 12))
    window, used, fold = _analysis()
    spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * window, axis=1)[:, used]
    chroma = ((spectrum.real**2 + spectrum.imag**2) @ fold).astype(float)
    norm = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.where(norm > 1e-3, chroma / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A packed integer for each frame that has SPAN frames from it on."""
    chroma = pitch_classes(samples)
    n = len(chroma) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        half, third = w // 2, w // 4
        if kind == 0:
            a = whole - area(0, w, y, y + h // 2)
        elif kind == 1:
            a = area(0, half, y, y + h)
        elif kind == 2:
            a = area(0, w, y, y + h // 2)
        elif kind == 3:
            a = area(0, half, y, y + h // 2) + area(half, w, y + h // 2, y + h)
        elif kind == 4:
            a = area(third, w - third, y, y + h)
        else:
            a = area(0, w, y + h // 3, y + h - h // 3)
        value = np.round(np.log((1 + a) / (1 + whole - a)), 9)
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        packed = packed << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return packed


def fingerprints(df: DataFrame, keep: list[str], column: str, read: Callable = read_pcm) -> DataFrame:
    """keep and ints (the packed integers, 4 bytes each) for each row of df."""

    def run(batch: pa.RecordBatch):
        got = [fingerprint(read(c)).astype("<u4").tobytes() for c in batch.column("_media").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(got, pa.binary())], names=[*keep, "ints"])

    return df.select(*keep, F.col(column).alias("_media")).mapInArrow(batches(run), schema_with(df, keep, "ints binary"))


def bit_error(a: bytes, b: bytes, offset: int) -> tuple[float, int]:
    """Share of differing bits where a, moved by offset, lies over b; and the length of that overlap."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    x, y = (x[offset:], y) if offset >= 0 else (x, y[-offset:])
    n = min(len(x), len(y))
    return (float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n), n) if n else (1.0, 0)


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """frequencies x prints x 32: the transforms of the bits, as 1 and -1."""
    signs = np.zeros((len(prints), size, 32), np.float32)
    for i, g in enumerate(prints):
        signs[i, : len(g)] = np.unpackbits(g.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1) * np.float32(2) - 1
    return np.fft.rfft(signs, axis=1).transpose(1, 0, 2)


def _smooth(n: int) -> int:
    """The least size from n on with no prime factor but 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def offsets_within(a: list[np.ndarray], b: list[np.ndarray], most_errors: float, least_frames: int) -> dict[tuple[int, int], list[int]]:
    """For pairs (number in a, number in b) every offset whose overlap is long enough and differs in few enough bits, or in 2 bits more."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    size = _smooth(max(2, int(la.max() + lb.max()) - least_frames + 1))
    x, y = np.ascontiguousarray(_spectra(a, size)), np.ascontiguousarray(_spectra(b, size).conj().transpose(0, 2, 1))
    agree = np.fft.irfft((x @ y).transpose(1, 2, 0), size)  # a x b x offsets
    at = np.arange(size)
    at = np.where(at <= la.max() - least_frames, at, at - size)
    if la.min() == la.max() and lb.min() == lb.max():
        la, lb = la[:1], lb[:1]
    over = np.minimum(la[:, None, None], lb[None, :, None] + at) - np.maximum(at, 0)
    need = np.where(over >= max(1, least_frames), 32 * (1 - 2 * most_errors) * over - 4, np.inf).astype(np.float32)
    found: dict[tuple[int, int], list[int]] = {}
    for i, j, k in np.argwhere(agree >= need).tolist():
        found.setdefault((i, j), []).append(int(at[k]))
    return found


def aligned(a: list[bytes], b: list[bytes], most_errors: float, least_frames: int):
    """number in a, number in b, offset, votes, frames, bit error of every aligned pair."""
    order = [np.array(sorted(range(len(x)), key=lambda i, x=x: len(x[i]))) for x in (a, b)]
    i = 0
    while i < len(a):  # runs of similar lengths, so many at once as memory holds
        step = max(1, math.isqrt((1 << 22) // (len(a[order[0][min(i + 128, len(a)) - 1]]) // 2 + 1)))
        rows = order[0][i : i + step]
        i, j = i + step, 0
        x = [np.frombuffer(a[n], "<u4") for n in rows]
        while j < len(b):
            longest = len(x[-1]) + len(b[order[1][min(j + 128, len(b)) - 1]]) // 4
            wide = max(1, (1 << 22) // (longest * len(x)))
            cols = order[1][j : j + min(wide, 128)]
            j += len(cols)
            y = [np.frombuffer(b[n], "<u4") for n in cols]
            for (p, q), offsets in offsets_within(x, y, most_errors, least_frames).items():
                best = None
                for o in offsets:
                    error, n = bit_error(a[rows[p]], b[cols[q]], o)
                    if error <= most_errors and n >= least_frames:
                        row = (round(32 * n * (1 - 2 * error)), -abs(o), o, n, error)
                        best = max(best or row, row)
                if best:
                    _, _, o, n, error = best
                    same = x[p][max(o, 0) :][:n] == y[q][max(-o, 0) :][:n]
                    yield int(rows[p]), int(cols[q]), o, int((same[1:] & same[:-1]).sum()), n, error


def align(prints: DataFrame, most_errors: float = 0.2, least_frames: int = 16) -> tuple[DataFrame, DataFrame]:
    """prints: id, is_query, ints.  Returns membership (id, class_id) and the aligned pairs of classes.

    Pairs: class_id (one that holds a query), other_id, frame_offset, votes (equal pairs of neighbouring
    integers on that offset), n_frames, bit_error.
    """
    named = materialise(prints.select("id", "is_query", "ints").withColumn("mark", F.when(F.length("ints") > 0, F.unhex(F.md5("ints")))), "prints")
    classes = materialise(named.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.min("id").alias("class_id"), F.max("is_query").alias("is_query"), F.first("ints").alias("ints")), "classes")
    member = named.select("id", "mark").join(classes.select("mark", "class_id"), "mark", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    long = classes.where((F.length("ints") >= 4 * least_frames) & F.col("class_id").isNotNull())
    sizes = long.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    n_own, n_other = max(1, -(-sizes["q"] // QUERIES)), max(1, -(-sizes["n"] // OTHERS))
    chunk = lambda n: F.pmod(F.xxhash64("mark"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = long.where("is_query").select(chunk(n_own).cast("int").alias("i"), every(n_other).alias("j"), F.lit(True).alias("own"), "class_id", "ints")
    met = long.select(every(n_own).alias("i"), chunk(n_other).cast("int").alias("j"), F.lit(False).alias("own"), "class_id", "ints")

    kind = classes.schema["class_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"].astype(bool)], pdf[~pdf["own"].astype(bool)]
        ids, others = a["class_id"].tolist(), b["class_id"].tolist()
        rows = [(ids[p], others[q], *rest) for p, q, *rest in aligned(a["ints"].tolist(), b["ints"].tolist(), most_errors, least_frames) if ids[p] != others[q]]
        return pd.DataFrame(rows, columns=["class_id", "other_id", "frame_offset", "votes", "n_frames", "bit_error"])

    return member, own.unionByName(met).groupBy("i", "j").applyInPandas(run, f"class_id {kind}, other_id {kind}, frame_offset int, votes long, n_frames long, bit_error double")


def op5_audio_align(spark, sf_dir: str) -> DataFrame:
    """Every vector of embeddings as a recording of tones: a row for each one's class, and for each aligned pair of classes.

    kind 'member': vec_id and its class_id; kind 'pair': class_id and other_id with their alignment.
    Queries are the vectors whose id is divisible by 50.
    """
    media = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (F.coalesce("vec_id", F.lit(1)) % 50 == 0).alias("is_query"), "embedding")
    member, pairs = align(fingerprints(media, ["id", "is_query"], "embedding", tones))
    none = lambda kind: F.lit(None).cast(kind)
    rows = member.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id", none("long").alias("other_id"), none("int").alias("frame_offset"), none("long").alias("votes"), none("long").alias("n_frames"), none("double").alias("bit_error"))
    return rows.unionByName(pairs.select(F.lit("pair").alias("kind"), none("long").alias("vec_id"), "class_id", "other_id", "frame_offset", "votes", "n_frames", "bit_error"))

"""Questions from blocks of documents to parts of a key space, and the answers back.

A corpus-wide table of words, word pairs or repeats has as many keys as the corpus has
words.  Instead of a row for each key, every block of documents (a hash of the row, so
that blocks are even) asks each part of the key space about its distinct keys in
one packed row, and gets one packed row back, in the order of the keys it asked for.
A key that holds a third of all words is one key for each block, so no part is hot.
Blocks and parts hold a bounded amount of text or keys, and their number follows the input;
a block makes rows only for parts that it has keys of, so it never makes more rows than it has keys.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def n_blocks(docs: DataFrame, total: int, block_bytes: int) -> int:
    """Blocks of about block_bytes of text; of small inputs as many as there are shuffle partitions, down to 1 MB."""
    least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (1 << 20)))
    return max(1, least, math.ceil(total / block_bytes))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths; their bytes are grouped by place, so that small numbers cost little."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of pack()."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, k in zip(sizes.tolist(), map(np.dtype, kinds), strict=True):
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
        at += n * k.itemsize
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; np.cumsum restores them."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key: equal ranges, so that sorted keys lie in sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def shares(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """part, begin, end of each run of sorted keys that belongs to one part; only parts that have keys."""
    if not len(keys):
        return []
    of = part_of(keys, parts)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return list(zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True))

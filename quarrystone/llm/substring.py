"""Operator 3, substring dedup: seed and extend.

Words are runs of anything but white space.  Seeds are winnowed anchors: of each nine
consecutive hashes of five words the least (the first of equal ones), so that every 13 words have one
anchor, which their words alone determine.  First the corpus is joined on anchors: those that
lie in one document alone are dropped.  Around the others the match is extended: all places
of an anchor start as one class, and word by word to the left and to the right each class parts into those
whose next words are equal, up to the eight words on either side that 13 words with the anchor can
reach.  Where a class to the left and one to the right together hold 13 words, its smallest
document keeps them.  Matches that follow one another make a maximal repeat, of 13 words or
more; its words go from every document but the smallest that has each 13 of them.

Extending classes instead of pairs makes the work linear in the places of an anchor, however many documents
share it.  An anchor with over HOT different surroundings (a line that a third of all documents hold among other words) is not
extended in one task: each of its windows goes where a hash of its own words sends it.  Both steps go through ``exchange``: packed questions of blocks of documents to parts
of the key space, with each distinct anchor or neighbourhood of a block once, so that neither a passage that a third of all documents share nor a
large group of copies lands in one task.

Words are compared as 64-bit hashes, those beside an anchor by their first 48 bits: two
different stretches are taken for one only if all their unlike words collide.

Defined results: null or empty text has no words; words of a document of fewer than 13
words all stay; a row with a null doc_id neither removes nor loses words; rows with the
same doc_id are one document in several pieces (none removes from another); a very long text is one document of
its block; columns of docs may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .common import BASE, mix, rolling, table, word_hashes, words_of

WINDOW, SEED = 13, 5
ROWS = "part int, block long, data binary"
#: Different surroundings of an anchor, over all documents, that one task extends.
HOT = 1000
NOBODY = np.iinfo(np.int64).max


def anchors_of(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor; and the hashes at all places."""
    g = rolling(h, seed)
    n = len(h) - window + 1
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, window - seed + 1):
        lower = g[j : j + n] < best
        best[lower] = g[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    return at, g


class Block:
    """The documents of a block: their words' hashes one after the other, and the anchors with the windows each stands for."""

    def __init__(self, pdf: pd.DataFrame, window: int, seed: int):
        self.docs = list(zip(pdf["doc_id"].tolist(), pdf["has_id"].tolist(), pdf["text"].tolist(), strict=True))
        self.window, self.seed, self.reach = window, seed, window - seed
        none = np.empty(0, np.int64)
        hashes, anchors, values, ids, first, last, of_window, left = [np.empty(0, np.uint64)], [none], [np.empty(0, np.uint64)], [none], [none], [none], [none], [none]
        self.windows, begin, n_anchors = [], 0, 0
        for doc_id, has_id, text in self.docs:
            words = words_of(text)
            if not has_id or len(words) < window:
                self.windows.append(0)
                continue
            h = word_hashes(words)
            at, g = anchors_of(h, window, seed)
            place, inverse = np.unique(at, return_inverse=True)
            hashes.append(h)
            anchors.append(place + begin)
            values.append(mix(g[place]))  # least hashes crowd at the low end; these do not
            ids.append(np.full(len(place), doc_id, np.int64))
            first.append(np.full(len(place), begin))
            last.append(np.full(len(place), begin + len(h)))
            of_window.append(inverse + n_anchors)
            left.append(at - np.arange(len(at)))
            self.windows.append(len(at))
            begin, n_anchors = begin + len(h), n_anchors + len(place)
        cat = np.concatenate
        self.hashes, self.place, self.value, self.ids, self.first, self.last = cat(hashes), cat(anchors), cat(values), cat(ids), cat(first), cat(last)
        self.anchor_of, self.left = cat(of_window), cat(left)  # of each window its anchor, and the words before the anchor

    def word_at(self, places: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The words at places of the documents of anchors `on`, of their first 48 bits; zero where there is none."""
        inside = (places >= self.first[on]) & (places < self.last[on])
        return np.where(inside, self.hashes[np.where(inside, places, 0)] >> np.uint64(16) | np.uint64(1), np.uint64(0)) if len(on) else np.empty(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct anchors, whether several documents of the block have each, and in how many different surroundings."""
        every = np.arange(len(self.place))
        ends = mix(self.word_at(self.place - self.reach, every) * BASE + self.word_at(self.place + self.seed - 1 + self.reach, every))
        order = np.lexsort((ends, self.value))
        v, d, e = self.value[order], self.ids[order], ends[order]
        if not len(v):
            return v, np.empty(0, bool), np.empty(0, np.int64)
        fresh = np.concatenate([[True], v[1:] != v[:-1]])
        begin = np.flatnonzero(fresh)
        kinds = np.add.reduceat((fresh | np.concatenate([[True], e[1:] != e[:-1]])).astype(np.int64), begin)
        return v[begin], np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin), kinds

    def neighbourhoods(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors with a flag: the distinct rows (route, which windows, words before, words behind), sorted by route; the least document of each; the row of each anchor and window, or -1.

        The route of an anchor is its hash.  With the flag 2 it has a row for each window, with the words of that window alone, whose hash is the route.
        """
        on = np.flatnonzero(flags)
        used = np.zeros(len(self.place), np.uint64)
        np.bitwise_or.at(used, self.anchor_of, np.uint64(1) << self.left.astype(np.uint64))
        steps = range(1, self.reach + 1)
        near = [self.word_at(self.place[on] - k, on) for k in steps] + [self.word_at(self.place[on] + self.seed - 1 + k, on) for k in steps]
        rows = np.stack([self.value[on], used[on], *near], axis=1) if len(on) else np.empty((0, 2 + 2 * self.reach), np.uint64)
        hot = flags[on] == 2
        made, anchors, lefts = [rows[~hot]], [on[~hot]], [np.full((~hot).sum(), -1)]
        for left in range(self.reach + 1):
            at = np.flatnonzero(hot & (rows[:, 1] >> np.uint64(left) & np.uint64(1)).astype(bool))
            window = rows[at].copy()
            window[:, 1] = 1 << left
            window[:, 2 + left : 2 + self.reach] = 0
            window[:, 2 + self.reach + self.reach - left :] = 0
            for k in range(1, window.shape[1]):
                window[:, 0] = mix(window[:, 0] * BASE + window[:, k])
            made.append(window)
            anchors.append(on[at])
            lefts.append(np.full(len(at), left))
        rows, anchor, left = np.ascontiguousarray(np.concatenate(made)), np.concatenate(anchors), np.concatenate(lefts)
        row_of = np.full((len(self.place), self.reach + 1), -1, np.int32)
        if not len(rows):
            return rows, np.empty(0, np.int64), row_of
        kind = np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))
        _, index, inverse = np.unique(rows.view(kind).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(rows[index, 0], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = back[inverse]
        least = np.full(len(index), NOBODY)
        np.minimum.at(least, at, self.ids[anchor])
        whole = left < 0
        row_of[anchor[whole]] = at[whole, None]
        row_of[anchor[~whole], left[~whole]] = at[~whole]
        return rows[index[order]], least, row_of


def _classes(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes parted by their next word."""
    number = np.unique(word, return_inverse=True)[1]
    return np.unique(parent * (number.max(initial=0) + 1) + number, return_inverse=True)[1]


def extend(rows: np.ndarray, low: np.ndarray, reach: int) -> np.ndarray:
    """For each row and number of words before the anchor the least document that has the window, NOBODY where the row stands for none.

    rows: route, windows it stands for (bits), words before the anchor from the nearest on, words behind it.
    """
    start = np.unique(rows[:, 0], return_inverse=True)[1]
    before, behind = [start], [start]
    for k in range(reach):
        before.append(_classes(before[-1], rows[:, 2 + k]))
        behind.append(_classes(behind[-1], rows[:, 2 + reach + k]))
    out = np.full((len(rows), reach + 1), NOBODY)
    for left in range(reach + 1):
        on = np.flatnonzero(rows[:, 1] >> np.uint64(left) & np.uint64(1))
        if len(on):
            whole = np.unique(before[left][on] * len(rows) + behind[reach - left][on], return_inverse=True)[1]
            least = np.full(whole.max() + 1, NOBODY)
            np.minimum.at(least, whole, low[on])
            out[on, left] = least[whole]
    return out


def dedup(docs: DataFrame, keep: list[str], window: int = WINDOW, seed: int = SEED, spans: bool = False, texts: bool = False, block_bytes: int = 16 << 20) -> DataFrame:
    """docs has doc_id and text; returns keep, n_words, n_removed, kept_sha256.

    spans adds the maximal repeats (array of start, end in words); texts adds the kept text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_cols"), F.xxhash64("doc_id", "text").alias("_h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    total = X.text_bytes(rows)
    blocks = parts = X.n_blocks(rows, total, block_bytes)
    by_block = rows.select("kept_cols", F.pmod("_h", F.lit(blocks)).alias("block"), "doc_id", "has_id", "text").groupBy("block")
    reach = window - seed
    words, most = [np.uint64] * (2 + 2 * reach), HOT

    def ask_anchors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, several, kinds = Block(pdf, window, seed).distinct()
        return pd.DataFrame([(p, key[0], X.pack(X.steps(keys[i:j]), several[i:j].astype(np.uint8), kinds[i:j].astype(np.uint32))) for p, i, j in X.shares(keys, parts)], columns=["part", "block", "data"])

    def join_anchors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [(np.cumsum(k, dtype=np.uint64), s, n) for k, s, n in (X.unpack(d, np.uint64, np.uint8, np.uint32) for d in pdf["data"])]
        _, at, count = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True, return_counts=True)
        several = count > 1
        several[at[np.concatenate([a[1] for a in asked]) > 0]] = True
        hot = several & (np.bincount(at, np.concatenate([a[2] for a in asked])) > most)
        return _replies(key, pdf, (several[at] + hot[at].astype(np.uint8)).astype(np.uint8), [len(a[0]) for a in asked], "a")

    def shared_anchors(b: Block, got: pd.DataFrame) -> np.ndarray:
        flags = [X.unpack(d, np.uint8)[0] for _, d in sorted(zip(got["part"], got["data"], strict=True))]
        keys = np.unique(b.value)
        return np.concatenate([np.empty(0, np.uint8), *flags])[np.searchsorted(keys, b.value)] if len(keys) else np.empty(0, np.uint8)

    def ask_neighbours(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, window, seed)
        near, low, _ = b.neighbourhoods(shared_anchors(b, got))
        packed = lambda i, j: X.pack(X.steps(near[i:j, 0]), low[i:j], *near[i:j, 1:].T)
        return pd.DataFrame([(p, key[0], packed(i, j)) for p, i, j in X.shares(np.ascontiguousarray(near[:, 0]), parts)], columns=["part", "block", "data"])

    def join_neighbours(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [X.unpack(d, np.uint64, np.int64, *words[1:]) for d in pdf["data"]]
        near = np.concatenate([np.stack([np.cumsum(a[0], dtype=np.uint64), *a[2:]], axis=1) for a in asked])
        least = extend(near, np.concatenate([a[1] for a in asked]), reach)
        return _replies(key, pdf, least, [len(a[0]) for a in asked], "n")

    names = [f.name for f in rows.schema["kept_cols"].dataType.fields]
    ddl = "n_words long, n_removed long, kept_sha256 string"
    ddl += ", repeats array<struct<start:int,end:int>>" * spans + ", kept_text string" * texts
    made_columns = [f.name for f in T.StructType.fromDDL(ddl).fields]
    schema = T.StructType([*rows.schema["kept_cols"].dataType.fields, *T.StructType.fromDDL(ddl).fields])

    def cut(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, window, seed)
        row_of = b.neighbourhoods(shared_anchors(b, got[got["kind"] == "a"]))[2]
        told = got[got["kind"] == "n"]
        parts_ = [np.stack(X.unpack(d, *[np.int64] * (reach + 1)), axis=1) for _, d in sorted(zip(told["part"], told["data"], strict=True))]
        least = np.concatenate([np.empty((0, reach + 1), np.int64), *parts_])
        covered = np.zeros(len(b.anchor_of), bool)
        row = row_of[b.anchor_of, b.left]
        on = np.flatnonzero(row >= 0)
        covered[on] = least[row[on], b.left[on]] < b.ids[b.anchor_of[on]]
        out, begin = [], 0
        for (_, _, text), size in zip(b.docs, b.windows, strict=True):
            has = words_of(text)
            hit = np.flatnonzero(covered[begin : begin + size])
            begin += size
            edge = np.zeros(len(has) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = has if not len(hit) else [w for w, g in zip(has, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            values = [len(has), len(has) - len(kept), hashlib.sha256(joined).hexdigest()]
            if spans:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                values.append([{"start": int(s), "end": int(e)} for s, e in turn.reshape(-1, 2)])
            if texts:
                values.append(joined.decode("utf-8", "replace"))
            out.append(values)
        cols = pdf["kept_cols"].tolist()
        kept_cols = [pd.Series([c[n] if isinstance(c, dict) else c[i] for c in cols], dtype=object) for i, n in enumerate(names)]
        made = pd.concat([*kept_cols, *[pd.Series([o[i] for o in out], dtype=object if i > 2 else None) for i in range(len(made_columns))]], axis=1)
        made.columns = [*names, *made_columns]
        return made

    reply = "block long, part int, data binary, kind string"
    first = by_block.applyInPandas(ask_anchors, ROWS).groupBy("part").applyInPandas(join_anchors, reply)
    second = by_block.cogroup(first.groupBy("block")).applyInPandas(ask_neighbours, ROWS).groupBy("part").applyInPandas(join_neighbours, reply)
    return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInPandas(cut, schema)


def _replies(key: tuple, pdf: pd.DataFrame, values: np.ndarray, sizes: list[int], kind: str) -> pd.DataFrame:
    """The rows of values (one or several columns) to the blocks that asked, so many to each."""
    ends = np.cumsum(sizes)
    data = [X.pack(*np.atleast_2d(values[e - n : e].T)) for n, e in zip(sizes, ends, strict=True)]
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "part": key[0], "data": data, "kind": kind})


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), ["doc_id"])


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
h AS (SELECT doc_id, k, i, array_to_string(w[i:i+12], ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS low FROM h GROUP BY s),
c AS (SELECT DISTINCT h.k, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN m ON m.s = h.s WHERE m.low < h.doc_id),
a AS (SELECT k, list(p) AS ps FROM c GROUP BY k),
u AS (SELECT d.doc_id, d.k, unnest(d.w) AS x, generate_subscripts(d.w, 1) AS p FROM d),
t AS (SELECT u.k, string_agg(u.x, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u LEFT JOIN c ON c.k = u.k AND c.p = u.p WHERE c.p IS NULL GROUP BY u.k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.k = d.k
"""

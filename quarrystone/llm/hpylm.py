"""Operator 7, LM scoring: a hierarchical Pitman-Yor model of word pairs.

Every word that stands before another in the training texts has a restaurant of its own,
whose customers are the words that follow it; all these restaurants share one parent, the
restaurant of single words, over a uniform base of all known words and one unknown.  A
table below is a customer above.  The seating is sampled by Gibbs: the customers of one
dish leave a restaurant and are seated again, given everyone else, at once; what is drawn
is their number of tables, from its exact conditional

    P(t) ~ S_d(c, t) * prod_{j < t} (theta + d * (other tables + j)) * P_parent(word)^t,

where S_d are generalised Stirling numbers: the weight of all seatings of c customers at t tables,
which is all that predictions need to know of the seating.  The rule is one for all counts, on both
levels.  Only the evaluation of S_d differs: up to EXACT customers by its recursion, beyond by a saddle point.

After ``first`` sweeps, ``samples`` sweeps each give a predictive probability of every word
pair, and these are averaged.  perplexity is 10 ** (-score / n_tokens).

How it runs: blocks of documents send each part of the key space their distinct word pairs, by
the first word, and their distinct words (``exchange``).  A part seats the restaurants of its first
words, and holds its words' customers in the parent.  Numbers of tables go from parts to parts after every
sweep, as sums of integers, and draws are hashes of seed, sweep and words: scores do not depend
on partitions.  No part is sent tokens, only distinct pairs with their counts.  One restaurant
is held by one part: as many entries as words follow its word, however often they do.

Words are told apart by 64-bit hashes; as followers in a restaurant and in the parent by the
first 48 bits (two of n words are taken for one with probability about n^2 / 2^49).

Defined results: null and empty texts have one token, the end; with nothing to learn
from, every word has the base probability; a null doc_id counts as the text 'None' for the
fold; a very long text is one document of its block; repeated rows are learned as often as they
occur and get equal results; columns of docs may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .common import BASE, materialise, mix, release, schema_with, table, word_hashes

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b" "  # no word holds a space
SHORT = np.uint64(16)  # bits that followers' hashes lack
EXACT = 1024
#: Kinds of packed rows.
PAIRS, WORDS, SEATS, FIRST, MORE, PARENT, KNOWN, TOTALS = range(8)
ROWS = "part int, kind int, peer long, data binary, stats array<long>"


def tokens_of(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    words.append(END)
    return word_hashes(words)


def held_out(doc_id, folds: int = 10) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


@lru_cache(maxsize=4)
def log_stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for 1 <= t <= c <= EXACT, -inf elsewhere; S_d(c + 1, t) = S_d(c, t - 1) + (c - d t) S_d(c, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        out[c + 1, 1:] = out[c, :-1]
        here = slice(1, c + 1)
        out[c + 1, here] = np.logaddexp(out[c + 1, here], out[c, here] + np.log(c - d * t[here]))
    return out


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) / c! for large c, by the saddle point of [z^c] ((1 - (1 - z)^d) / d)^t / t!, without what is the same for all t."""
    mean = c / t  # customers of a table
    low, high = np.full(np.shape(mean), -300.0), np.full(np.shape(mean), -1e-12)  # of log y, y = 1 - z
    for _ in range(45):
        mid = (low + high) / 2
        more = np.exp((d - 1) * mid) * -np.expm1(mid) * d / -np.expm1(d * mid) > mean
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    log_y = (low + high) / 2
    z, g = -np.expm1(log_y), -np.expm1(d * log_y) / d
    spread = mean + z * z * (1 - d) * np.exp((d - 2) * log_y) / g - mean * mean
    log_factorial = (t + 0.5) * np.log(t) - t + 1 / (12 * t)
    return t * np.log(g) - c * np.log(z) - 0.5 * np.log(t * spread) - log_factorial


def few_tables(c: np.ndarray, most: int, d: float) -> np.ndarray:
    """log S_d(c, t) for large c (a row each) and t = 1 ... most, without what is the same for all t, by its alternating sum of rising factorials of -k d."""
    log_gamma = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x)
    terms = [(-1) ** k * np.exp(log_gamma(c - k * d) - log_gamma(c - d)) / math.gamma(-k * d) if (k * d) % 1 else 0 * c for k in range(1, most + 1)]
    sums = [sum(math.comb(t, k) * terms[k - 1] for k in range(1, t + 1)) for t in range(1, most + 1)]
    return np.stack([np.log(np.maximum(s, 1e-300)) - t * math.log(d) - math.lgamma(t + 1) for t, s in enumerate(sums, 1)], axis=1)


def log_ratio(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t + 1) / S_d(c, t) for large c and 1 <= t < c."""
    out = saddle(c, t + 1.0, d) - saddle(c, t, d)
    most = int(40 * d)  # where the sum is exact, and the saddle point not yet
    if most > 1 and (t < most).any():
        table = np.diff(few_tables(c.reshape(len(c)), most, d), axis=1)
        rows = np.broadcast_to(np.arange(len(c)).reshape(c.shape), t.shape)
        near = (t <= most - 1) & (t == np.floor(t))
        out[near] = table[rows[near], t[near].astype(np.int64) - 1]
    return out


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, theta: float, u: np.ndarray) -> np.ndarray:
    """The tables of c customers of one dish, given the other tables of their restaurant and the dish's probability p in the parent; u is uniform."""
    t = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    sizes, begin = np.unique(c[order], return_index=True)
    begin = np.append(begin, len(c))
    stirling = log_stirling(d)
    for k, size in enumerate(sizes.tolist()):
        if size < 2 or size > EXACT:
            continue
        step = max(1, (1 << 20) // size)
        for i in range(begin[k], begin[k + 1], step):
            at = order[i : min(i + step, begin[k + 1])]
            w = np.cumsum(np.log((theta + d * (others[at, None] + np.arange(size))) * p[at, None]), axis=1) + stirling[size, 1 : size + 1]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (w < (u[at] * w[:, -1])[:, None]).sum(axis=1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        n, other, q = c[at].astype(float), others[at].astype(float), p[at]
        rise = lambda x: log_ratio(n, x, d) + np.log((theta + d * (other + x)) * q)
        low, high = np.ones(len(at)), n - 1.0
        for _ in range(math.ceil(math.log2(n.max())) + 1):  # the mode: the weights rise up to it and fall from it
            mid = np.floor((low + high) / 2)
            up = rise(mid) > 0
            low, high = np.where(up, mid + 1, low), np.where(up, high, mid)
        near = np.clip(low, 2, np.maximum(n - 2, 2))
        width = 1 / np.sqrt(np.maximum(rise(near - 1) - rise(near), 2e-18))
        stride = np.maximum(1, np.ceil(width / 4))
        grid = low[:, None] + stride[:, None] * np.arange(-24, 25)
        inside = (grid >= 1) & (grid <= n[:, None])
        x = np.clip(grid + (stride[:, None] - 1) / 2, 1, n[:, None] - 1)
        slope = log_ratio(n[:, None], x, d) + np.log((theta + d * (other[:, None] + x)) * q[:, None])
        w = np.concatenate([np.zeros((len(at), 1)), np.cumsum(slope[:, :-1] * stride[:, None], axis=1)], axis=1)
        w = np.where(inside, w, -np.inf)
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        want = u[at] * w[:, -1]
        k = (w < want[:, None]).sum(axis=1)
        rows = np.arange(len(at))
        below = np.where(k > 0, w[rows, k - 1], 0.0)
        share = (want - below) / np.maximum(w[rows, k] - below, 1e-300)
        t[at] = np.clip(grid[rows, k] + np.floor(share * stride) - np.floor((stride - 1) / 2), 1, n).astype(np.int64)
    return t


def uniform(*keys) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for k in keys:
        h = mix((h + np.atleast_1d(np.asarray(k, np.uint64))) * BASE + BASE)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Block:
    """The documents of a block as numbers of distinct words and of distinct pairs."""

    def __init__(self, pdf: pd.DataFrame, folds: int):
        tokens = [tokens_of(t) for t in pdf["text"].tolist()]
        self.held = np.array([held_out(i if h else None, folds) for i, h in zip(pdf["doc_id"].tolist(), pdf["has_id"].tolist(), strict=True)], bool)
        self.sizes = np.array([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        del tokens
        train = np.repeat(~self.held, self.sizes)
        self.words, self.word = np.unique(flat, return_inverse=True)
        self.counts = np.bincount(self.word, train, len(self.words)).astype(np.int64)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]  # the token before a text's first one is an end, as every text's last one is
        before[0] = self.word[-1]
        self.pairs, self.pair = np.unique(before * len(self.words) + self.word, return_inverse=True)
        self.pair_counts = np.bincount(self.pair, train, len(self.pairs)).astype(np.int64)
        self.first, self.second = self.pairs // len(self.words), self.pairs % len(self.words)
        self.firsts, self.begin = np.unique(self.first, return_index=True)

    def questions(self, block: int, parts: int) -> pd.DataFrame:
        rows = []
        words = self.words
        for p, i, j in X.shares(words, parts):
            rows.append((p, WORDS, block, X.pack(X.steps(words[i:j]), self.counts[i:j].astype(np.uint32)), None))
        begin = np.append(self.begin, len(self.pairs))
        follow = words[self.second] >> SHORT
        gap = follow.copy()
        gap[1:] -= follow[:-1]
        gap[self.begin] = follow[self.begin]
        for p, i, j in X.shares(words[self.firsts], parts):
            e = slice(begin[i], begin[j])
            n = np.diff(begin[i : j + 1]).astype(np.uint32)
            rows.append((p, PAIRS, block, X.pack(X.steps(words[self.firsts[i:j]]), n, gap[e], self.pair_counts[e].astype(np.uint32)), None))
        return pd.DataFrame(rows, columns=["part", "kind", "peer", "data", "stats"])


def _asked_pairs(data: bytes) -> tuple[np.ndarray, ...]:
    """first words, followers of each, followers, counts of a PAIRS row."""
    up, n, gap, count = X.unpack(data, np.uint64, np.uint32, np.uint64, np.uint32)
    total = np.cumsum(gap, dtype=np.uint64)
    begin = np.concatenate([[0], np.cumsum(n.astype(np.int64))[:-1]]).astype(np.int64)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0)) if len(begin) else total
    return np.cumsum(up, dtype=np.uint64), n.astype(np.int64), total - np.repeat(before, n), count


class Part:
    """What blocks asked of one part: their distinct words, and the pairs of its first words."""

    def __init__(self, pdf: pd.DataFrame):
        self.blocks = {}
        pairs = [(int(b), _asked_pairs(d)) for k, b, d in zip(pdf["kind"], pdf["peer"], pdf["data"], strict=True) if k == PAIRS]
        words = [(int(b), X.unpack(d, np.uint64, np.uint32)) for k, b, d in zip(pdf["kind"], pdf["peer"], pdf["data"], strict=True) if k == WORDS]
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        self.words, at = np.unique(cat([np.cumsum(w[0], dtype=np.uint64) for _, w in words], np.uint64), return_inverse=True)
        self.counts = np.bincount(at, cat([w[1] for _, w in words], np.uint32), len(self.words)).astype(np.int64)
        ends = np.cumsum([0, *[len(w[0]) for _, w in words]])
        self.asked_words = [(b, at[i:j]) for (b, _), i, j in zip(words, ends[:-1], ends[1:], strict=True)]
        self.firsts, of = np.unique(cat([p[0] for _, p in pairs], np.uint64), return_inverse=True)
        first = np.repeat(of, cat([p[1] for _, p in pairs], np.int64))
        self.seconds, second = np.unique(cat([p[2] for _, p in pairs], np.uint64), return_inverse=True)
        codes, at = np.unique(first * max(1, len(self.seconds)) + second, return_inverse=True)
        self.pair_counts = np.bincount(at, cat([p[3] for _, p in pairs], np.uint32), len(codes)).astype(np.int64)
        self.first, self.second = codes // max(1, len(self.seconds)), codes % max(1, len(self.seconds))
        ends, heads = np.cumsum([0, *[len(p[2]) for _, p in pairs]]), np.cumsum([0, *[len(p[0]) for _, p in pairs]])
        self.asked_pairs = [(b, of[g:h], at[i:j]) for (b, _), g, h, i, j in zip(pairs, heads[:-1], heads[1:], ends[:-1], ends[1:], strict=True)]
        self.seated = np.flatnonzero(self.pair_counts > 1)  # one customer has one table


def _messages(kind: int, peer: int, words: np.ndarray, numbers: np.ndarray, parts: int) -> list[tuple]:
    """Sorted 48-bit words with a number each, to the parts that hold them."""
    return [(p, kind, peer, X.pack(X.steps(words[i:j]), numbers[i:j].astype(np.uint32)), None) for p, i, j in X.shares(words << SHORT, parts)]


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "peer", "data", "stats"])


class Sizes:
    """What the whole corpus says: tokens, distinct words, and the discounts of both levels from counts of counts."""

    def __init__(self, tokens: int, words: int, ones: int, twos: int, pair_ones: int, pair_twos: int, theta: float):
        discount = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        self.tokens, self.words, self.theta = tokens, words, theta
        self.d0, self.d1 = discount(ones, twos), discount(pair_ones, pair_twos)

    def parent(self, customers, tables, all_customers, all_tables) -> np.ndarray:
        """Probabilities of words in the parent."""
        return (customers - self.d0 * tables + (self.theta + self.d0 * all_tables) / (self.words + 1)) / (self.theta + all_customers)


def seat_first(part: int, p: Part, parts: int) -> list[tuple]:
    """One table for each dish everywhere: the part's seats, its words' contexts, and what the whole corpus must know."""
    on = p.pair_counts > 0
    contexts = np.bincount(p.second[on], minlength=len(p.seconds)).astype(np.int64)
    known = np.flatnonzero(contexts)
    single = np.bincount(p.first[on], minlength=len(p.firsts)).astype(np.int64)
    s = p.seated
    own, first = np.unique(p.first[s], return_inverse=True)
    words, second = np.unique(p.seconds[p.second[s]], return_inverse=True)
    single = single[own] - np.bincount(first, minlength=len(own)).astype(np.int64)
    seats = X.pack(p.firsts[own], single, first.astype(np.uint32), words, second.astype(np.uint32), p.pair_counts[s], np.ones(len(s), np.int64), np.empty(0, np.int64))
    n = p.counts
    stats = [int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum()), int((p.pair_counts == 1).sum()), int((p.pair_counts == 2).sum())]
    rows = [(part, SEATS, part, seats, stats)]
    rows += _messages(FIRST, part, p.seconds[known], contexts[known], parts)
    return rows + _messages(MORE, part, words, np.zeros(len(words), np.int64), parts)


def seat_parent(part: int, pdf: pd.DataFrame, sizes: Sizes, totals: tuple[int, int] | None, sweep: int, sampled: bool, seed: int) -> list[tuple]:
    """The parent's customers as the parts below report them, seated again; what is asked of them; rows for the parts pass."""
    out, first, more, held = [], [], [], None
    for kind, peer, data in zip(pdf["kind"], pdf["peer"], pdf["data"], strict=True):
        if kind == SEATS:
            out.append((part, SEATS, int(peer), data, None))
        elif kind == PARENT:
            held = data
        else:
            (first if kind == FIRST else more).append((int(peer), *X.unpack(data, np.uint64, np.uint32)))
    more = [(peer, np.cumsum(w, dtype=np.uint64), n) for peer, w, n in more]
    if held is None:
        words, at = np.unique(np.concatenate([np.cumsum(f[1], dtype=np.uint64) for f in first] or [np.empty(0, np.uint64)]), return_inverse=True)
        contexts = np.bincount(at, np.concatenate([f[2] for f in first] or [np.empty(0, np.uint32)]), len(words)).astype(np.int64)
        tables, kept = np.ones(len(words), np.int64), np.empty(0, np.int64)
    else:
        words, contexts, tables, kept = X.unpack(held, np.uint64, np.int64, np.int64, np.int64)
    customers = contexts.copy()
    for _, w, n in more:
        customers[np.searchsorted(words, w)] += n
    all_tables = totals[1] if totals else sizes.words
    tables = draw_tables(customers, all_tables - tables, np.full(len(words), 1 / (sizes.words + 1)), sizes.d0, sizes.theta, uniform(seed, 2 * sweep, words))
    if sampled:
        kept = np.concatenate([kept, customers, tables])
    out.append((part, PARENT, part, X.pack(words, contexts, tables, kept), [int(customers.sum()), int(tables.sum())]))
    for peer, w, _ in more:
        at = np.searchsorted(words, w)
        out.append((peer, KNOWN, part, X.pack(customers[at], tables[at]), None))
    return out


def seat_below(part: int, pdf: pd.DataFrame, sizes: Sizes, totals: tuple[int, int], parts: int, sweep: int, sampled: bool, seed: int, turns: int = 2) -> list[tuple]:
    """The restaurants of a part seated again, ``turns`` times, given the parent; the parent's rows pass."""
    out, known, seats = [], [], None
    for kind, peer, data in zip(pdf["kind"], pdf["peer"], pdf["data"], strict=True):
        if kind == PARENT:
            out.append((part, PARENT, int(peer), data, None))
        elif kind == KNOWN:
            known.append((int(peer), data))
        else:
            seats = data
    if seats is None:
        return out
    own, single, first, words, second, counts, tables, kept = X.unpack(seats, np.uint64, np.int64, np.uint32, np.uint64, np.uint32, np.int64, np.int64, np.int64)
    got = [X.unpack(d, np.int64, np.int64) for _, d in sorted(known)]  # by part, so in the order of words
    customers, parent_tables = (np.concatenate([g[i] for g in got] or [np.empty(0, np.int64)]) for i in range(2))
    p = sizes.parent(customers, parent_tables, *totals)[second]
    for turn in range(turns):
        of = single + np.bincount(first, tables, len(own)).astype(np.int64)
        tables = draw_tables(counts, of[first] - tables, p, sizes.d1, sizes.theta, uniform(seed, 2 * sweep + 1, turn, own[first], words[second]))
    if sampled:
        kept = np.concatenate([kept, tables])
    out.append((part, SEATS, part, X.pack(own, single, first, words, second, counts, tables, kept), None))
    return out + _messages(MORE, part, words, np.bincount(second, tables - 1, len(words)).astype(np.int64), parts)


def answer(p: Part, pdf: pd.DataFrame, samples: int) -> list[tuple]:
    """To every block: of its words the count, and customers and tables in the parent; of its first words customers and tables, of its pairs counts and tables; tables and customers of the parent for each sample."""
    seats = next((d for k, d in zip(pdf["kind"], pdf["data"], strict=True) if k == SEATS), None)
    parent = next((d for k, d in zip(pdf["kind"], pdf["data"], strict=True) if k == PARENT), None)
    below = np.zeros((samples, len(p.pair_counts)), np.int64)
    below[:, p.pair_counts == 1] = 1
    if seats is not None and len(p.seated):
        below[:, p.seated] = X.unpack(seats, np.uint64, np.int64, np.uint32, np.uint64, np.uint32, np.int64, np.int64, np.int64)[-1].reshape(samples, -1)
    above = np.zeros((2 * samples, len(p.words)), np.int64)
    if parent is not None and len(p.words):
        words, _, _, kept = X.unpack(parent, np.uint64, np.int64, np.int64, np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, p.words >> SHORT), len(words) - 1)
            has = words[at] == p.words >> SHORT
            above[:, has] = kept.reshape(2 * samples, -1)[:, at[has]]
    of = np.array([np.bincount(p.first, row, len(p.firsts)) for row in [p.pair_counts, *below]]).astype(np.int64)
    rows = [(b, WORDS, X.pack(p.counts[at], *[row[at] for row in above])) for b, at in p.asked_words]
    return rows + [(b, PAIRS, X.pack(*[row[f] for row in of], p.pair_counts[at].astype(np.uint32), *[row[at].astype(np.uint32) for row in below])) for b, f, at in p.asked_pairs]


def predictive(b: Block, replies: pd.DataFrame, sizes: Sizes, totals: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word of a block the training count; of each distinct pair the predictive probability, averaged over the samples."""
    s = len(totals)
    got = {k: [d for _, d in sorted(zip(g["part"], g["data"], strict=True))] for k, g in replies.groupby("kind")}
    join = lambda rows: [np.concatenate(x) for x in zip(*rows, strict=True)]
    words = join([X.unpack(d, *[np.int64] * (1 + 2 * s)) for d in got[WORDS]])
    pairs = join([X.unpack(d, *[np.int64] * (1 + s), *[np.uint32] * (1 + s)) for d in got[PAIRS]])
    counts, of, c = words[0], np.searchsorted(b.firsts, b.first), pairs[1 + s].astype(float)
    all_of = pairs[0][of]
    p = np.zeros(len(b.pairs))
    for i in range(s):
        above = sizes.parent(words[1 + 2 * i], words[2 + 2 * i], *totals[i])[b.second]
        own = (c - sizes.d1 * pairs[2 + s + i] + (sizes.theta + sizes.d1 * pairs[1 + i][of]) * above) / (sizes.theta + all_of)
        p += np.where(all_of > 0, own, above)
    return counts, p / s


def score_texts(docs: DataFrame, keep: list[str], folds: int = 10, theta: float = 1.0, first: int = 2, samples: int = 3, seed: int = 11, block_bytes: int = 32 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """keep, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_cols"), F.xxhash64("doc_id", "text").alias("_h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    total = X.text_bytes(rows)
    blocks, parts = X.n_blocks(rows, total, block_bytes), X.n_blocks(rows, total, part_bytes)
    by_block = rows.select("kept_cols", F.pmod("_h", F.lit(blocks)).alias("block"), "doc_id", "has_id", "text").groupBy("block")
    asked = by_block.applyInPandas(lambda key, pdf: Block(pdf, folds).questions(key[0], parts), ROWS)
    by_part = lambda df, fn: df.groupBy("part").applyInPandas(lambda key, pdf: _table(fn(int(key[0]), pdf)), ROWS)

    state = materialise(by_part(asked, lambda part, pdf: seat_first(part, Part(pdf), parts)), "seats")
    sums = state.where("kind = %d" % SEATS).agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(6)]).first()
    sizes = Sizes(*[int(x or 0) for x in sums], theta)
    totals, kept = None, []
    for sweep in range(first + samples + 1):
        moved = state
        if sweep:
            moved = by_part(state, lambda part, pdf, t=totals, s=sweep: seat_below(part, pdf, sizes, t, parts, s, s > first, seed))
        fresh = materialise(by_part(moved, lambda part, pdf, t=totals, s=sweep: seat_parent(part, pdf, sizes, t, s, s > first, seed)), "seats")
        release(state)
        state = fresh
        got = state.where("kind = %d" % PARENT).agg(F.sum(F.get("stats", F.lit(0))).alias("customers"), F.sum(F.get("stats", F.lit(1))).alias("tables")).first()
        totals = (int(got["customers"] or 0), int(got["tables"] or 0))
        kept += [totals] * (sweep > first)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the queries that are done

    names = [f.name for f in rows.schema["kept_cols"].dataType.fields]
    columns = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = schema_with(docs, [f"`{c}`" for c in keep], "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)], *schema.fields[len(names) :]])

    def reply(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*r, int(key[0])) for r in answer(Part(pdf), state, len(kept))], columns=["block", "kind", "data", "part"])

    def score(key: tuple, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, folds)
        counts, p = predictive(b, replies, sizes, kept)
        doc = np.repeat(np.arange(len(pdf)), b.sizes)
        add = lambda x: np.bincount(doc, x, len(pdf))
        base = np.log10((counts + 0.1) / (sizes.tokens + 0.1 * (sizes.words + 1)))
        got = add(np.log10(p)[b.pair])
        values = [b.held, b.sizes, add((counts > 0)[b.word]).astype(np.int64), np.full(len(pdf), sizes.tokens), add(base[b.word]), got, 10 ** (-got / b.sizes)]
        cols = pdf["kept_cols"].tolist()
        made = [pd.Series([k[n] if isinstance(k, dict) else k[i] for k in cols], dtype=object) for i, n in enumerate(names)] + [pd.Series(v) for v in values]
        out = pd.concat(made, axis=1)
        out.columns = [*names, *columns]
        return out

    seats = state.where(F.col("kind").isin(SEATS, PARENT)).groupBy("part")
    replies = asked.groupBy("part").cogroup(seats).applyInPandas(reply, "block long, kind int, data binary, part int")
    return by_block.cogroup(replies.groupBy("block")).applyInPandas(score, schema)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

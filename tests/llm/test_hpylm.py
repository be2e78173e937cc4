"""The language model against exact laws, a plain sampler, and itself on other partitions."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarrystone.llm import hpylm as H

SF = "/root/testdata/sf0.001"


def stirling(c, d):
    row = [-math.inf, 0.0]
    for n in range(1, c):
        row = [-math.inf, *[np.logaddexp(row[t - 1], row[t] + math.log(n - d * t) if t < len(row) else -math.inf) for t in range(1, n + 2)]]
    return np.array(row)


@pytest.mark.parametrize(("c", "others", "p", "d", "theta"), [(2, 3, 0.2, 0.8, 1.0), (7, 0, 0.9, 0.5, 1.0), (40, 90, 0.01, 0.3, 2.0), (1500, 500, 0.02, 0.7, 1.0), (1500, 3, 1e-4, 0.6, 1.0), (2000, 4000, 0.3, 0.8, 1.0)])
def test_drawn_tables_follow_their_exact_law(c, others, p, d, theta):
    t = np.arange(1, c + 1)
    w = stirling(c, d)[1:] + np.cumsum(np.log((theta + d * (others + t - 1)) * p))
    law = np.exp(w - w.max())
    law /= law.sum()
    n = 20_000 if c <= 1024 else 2_000
    u = (np.arange(n) + 0.5) / n  # evenly through the law
    got = H.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, theta, u)
    mean, sd = (law * t).sum(), math.sqrt((law * t**2).sum() - (law * t).sum() ** 2)
    assert abs(got.mean() - mean) < 0.03 * sd + 0.01 and abs(got.std() - sd) < 0.03 * sd + 0.01
    seen = np.bincount(got, minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(seen) - np.cumsum(law)).max() < 0.03


def test_mode_of_very_many_customers_is_found_at_once():
    got = H.draw_tables(np.array([10**9, 10**9]), np.array([10**6, 0]), np.array([0.1, 1e-9]), 0.8, 1.0, np.array([0.5, 0.5]))
    assert 1 <= got[1] < 10 and 10**5 < got[0] < 10**6


class Model:
    """The operator's own functions without Spark."""

    def __init__(self, docs, first, samples, parts=3, seed=5):
        block = H.Block(pd.DataFrame({"doc_id": [i for i, _ in docs], "has_id": True, "text": [t for _, t in docs]}), 10)
        by = lambda rows: pd.DataFrame(rows, columns=["part", "kind", "peer", "data", "stats"]).groupby("part")
        asked = {p: g for p, g in block.questions(0, parts).groupby("part")}
        rows = [r for p, g in asked.items() for r in H.seat_first(p, H.Part(g), parts)]
        self.sizes = H.Sizes(*np.sum([r[4] for r in rows if r[4]], axis=0).tolist(), 1.0)
        totals, kept = None, []
        for sweep in range(first + samples + 1):
            if sweep:
                rows = [r for p, g in by(rows) for r in H.seat_below(p, g, self.sizes, totals, parts, sweep, sweep > first, seed)]
            rows = [r for p, g in by(rows) for r in H.seat_parent(p, g, self.sizes, totals, sweep, sweep > first, seed)]
            totals = tuple(np.sum([r[4] for r in rows if r[4]], axis=0).tolist())
            kept += [totals] * (sweep > first)
        state = {p: g[g["kind"].isin([H.SEATS, H.PARENT])] for p, g in by(rows)}
        replies = pd.DataFrame([(*r, p) for p, g in asked.items() for r in H.answer(H.Part(g), state.get(p, by(rows).obj[:0]), samples)], columns=["block", "kind", "data", "part"])
        self.counts, self.p = H.predictive(block, replies, self.sizes, kept)
        self.block = block

    def pair(self, u, w):
        b = self.block
        h = {x: H.word_hashes([x.encode() if x else H.END])[0] for x in (u, w)}
        i, j = (int(np.searchsorted(b.words, h[x])) for x in (u, w))
        return self.p[np.searchsorted(b.pairs, i * len(b.words) + j)]


def corpus():
    train = ["a b a b c", "a a b", "c a b c a", "b", "d a", "a b d", "a a a a b b"]
    ids = [i for i in range(1, 60) if not H.held_out(i)][: len(train)]
    held = [i for i in range(1, 4000) if H.held_out(i)]
    words = ["a", "b", "c", "d", "zzz"]
    asks = [f"{u} {w}" for u in words for w in words] + ["", *words]
    return list(zip(ids, train, strict=True)) + list(zip(held, asks)), train, words


def test_probabilities_add_up_to_one():
    docs, _, words = corpus()
    model = Model(docs, 2, 3)
    for u in [*words, ""]:
        assert math.isclose(sum(model.pair(u, w) for w in [*words, ""]), 1, rel_tol=1e-9)


def plain_sampler(train, sizes, sweeps, burn, seed):
    """Customers seated one by one, in dictionaries of lists; mean predictive probability of pairs."""
    rng = random.Random(seed)
    d = (sizes.d0, sizes.d1)
    rooms = {}  # None is the parent
    pairs = [(u, w) for t in train for u, w in zip(["", *t.split()], [*t.split(), ""])]

    def tables(u):
        return sum(len(x) for x in rooms.get(u, {}).values())

    def chance(u, w):
        dd = d[0] if u is None else d[1]
        own = rooms.get(u, {})
        n = sum(map(sum, own.values()))
        up = 1 / (sizes.words + 1) if u is None else chance(None, w)
        mine = own.get(w, [])
        return (sum(mine) - dd * len(mine) + (sizes.theta + dd * tables(u)) * up) / (sizes.theta + n)

    def join(u, w):
        dd = d[0] if u is None else d[1]
        mine = rooms.setdefault(u, {}).setdefault(w, [])
        up = 1 / (sizes.words + 1) if u is None else chance(None, w)
        weights = [x - dd for x in mine] + [(sizes.theta + dd * tables(u)) * up]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(mine):
            mine.append(1)
            if u is not None:
                join(None, w)
        else:
            mine[k] += 1

    def leave(u, w):
        mine = rooms[u][w]
        k = rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            if u is not None:
                leave(None, w)

    for u, w in pairs:
        join(u, w)
    words = sorted({w for _, w in pairs})
    total = Counter()
    for s in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            join(u, w)
        if s >= burn:
            for u in words:
                for w in words:
                    total[u, w] += chance(u, w)
    return {k: v / (sweeps - burn) for k, v in total.items()}


def test_averages_agree_with_a_plain_sampler():
    docs, train, _ = corpus()
    model = Model(docs, 20, 200)
    want = plain_sampler(train, model.sizes, 500, 50, 3)
    for (u, w), p in want.items():
        assert abs(model.pair(u, w) - p) < 0.02 + 0.05 * p, (u, w, model.pair(u, w), p)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seen = []
    for n in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append({r["doc_id"]: r["score"] for r in H.score_texts(docs, ["doc_id"], samples=2, block_bytes=(1 << 20) // n, part_bytes=(1 << 20) // n).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen[0]) == len(seen[1]) == 200
    assert all(math.isclose(s, seen[1][i], rel_tol=1e-12) for i, s in seen[0].items())


def test_texts_that_occur_again_score_higher(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    ids = [i for i in range(2000) if not H.held_out(i)]
    lone = [(i, text()) for i in ids[:150]]
    twice = [(i, t) for k, t in enumerate([text() for _ in range(20)]) for i in (ids[200 + 2 * k], ids[201 + 2 * k])]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in H.score_texts(spark.createDataFrame(lone + twice, "doc_id long, text string"), ["doc_id"]).collect()}
    assert min(got[i] for i, _ in twice) > max(got[i] for i, _ in lone)

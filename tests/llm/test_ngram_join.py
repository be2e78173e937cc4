"""The n-gram join against all pairs."""

import itertools
import re

import numpy as np
import pytest

from quarrystone.llm import ngram_join as J


def plain_set(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    k = min(k, len(words)) or 1
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain(rows, k=4, percent=85):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) by all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, node string, n int")
    got = J.joined(df, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain(rows, **options)


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 85), (3, 60), (4, 95)])
def test_sets_of_words(spark, seed, percent):
    """Shingles of one word make any sets: families with changes about the threshold, chains, sets that share all but their commonest words, and equal prefixes."""
    rng = np.random.default_rng(seed)
    vocab = 400
    draw = lambda size: set((vocab * rng.random(size) ** 3).astype(int).tolist())
    sets = [draw(int(rng.integers(1, 40))) for _ in range(150)]
    for _ in range(250):  # a copy of any earlier one, copies included, with a few words out and in
        s = set(sets[int(rng.integers(len(sets)))])
        for _ in range(int(rng.integers(0, 4))):
            if s and rng.random() < 0.5:
                s.discard(int(rng.choice(sorted(s))))
            else:
                s |= draw(1)
        sets.append(s)
    common = list(range(30))
    for _ in range(60):  # the same rare words and other common ones: equal prefixes and sizes
        sets.append({1000, 1001, 1002, 1003} | set(rng.choice(common, 16, replace=False).tolist()))
    rows = [(i, " ".join(f"w{x}" for x in rng.permutation(sorted(s)))) for i, s in enumerate(sets)]
    compare(spark, rows, k=1, percent=percent)


def test_texts(spark):
    """Near copies with a passage that most texts share, letters of either case, repeated rows and ids, short, blank and null texts."""
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(3000)])
    passage = " ".join(rng.choice(words, 60))
    bodies = [" ".join(rng.choice(words, int(rng.integers(5, 90)))) for _ in range(60)]
    rows = []
    for i, body in enumerate(bodies):
        text = f"{body} {passage}" if i % 3 else body
        rows.append((len(rows), text))
        for _ in range(i % 7):
            w = text.split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = str(rng.choice(words))
            text = " ".join(w)
            rows.append((len(rows), text.upper() if i % 2 else text))
    rows += [(900, "one two"), (901, "ONE\ttwo"), (902, "one two three"), (903, ""), (904, None), (905, " \n"), (906, ""), (None, "one two"), (None, "lonely text of nobody at all"), (900, "other text under the same number"), rows[0], rows[0]]
    rows += [(907, "É a b c d e"), (908, "é a b c d e"), (909, "x" * 100_000), (910, " ".join(f"y{i}" for i in range(20_000)))]
    compare(spark, rows)


def test_one_large_family(spark):
    """Hundreds of near copies of one text, some of which only meet through others, and many that share just a passage with it."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in range(int(rng.integers(0, 4))):
            w[int(rng.integers(60))] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:40], *[f"t{i}x{j}" for j in range(int(rng.integers(0, 9)))]])) for i in range(200)]
    compare(spark, rows)


def test_blocks_and_parts_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words, 50))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(20)]
    monkeypatch.setattr(J.X, "n_blocks", lambda docs, total, size: 7)
    compare(spark, rows)


def test_prefix_is_no_longer_than_needed():
    for n in range(1, 500):
        least = min(o for o in range(1, n + 1) if 100 * o >= 85 * n)
        assert J.prefix_length(n) == n - least + 1


def test_empty_table(spark, empty, folder):
    assert J.op11_ngram_join(spark, folder(documents=empty)).collect() == []

"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from quarrystone.llm import quantize as Q


def plain(vectors, parts, entries, rounds):
    """Codes, errors and books by definition, one number at a time."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    size = len(x[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for v in x] for p in range(parts)]
    books = [[list(c) for c in column[:entries]] for column in cut]

    def near(c, book):
        d = [sum((a - b) ** 2 for a, b in zip(c, e)) for e in book]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = [near(c, books[p])[0] for c in cut[p]]
            for e in range(len(books[p])):
                own = [c for c, k in zip(cut[p], of) if k == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    last = [[near(c, books[p]) for c in cut[p]] for p in range(parts)]
    codes = ["".join(f"{last[p][i][0]:02x}" for p in range(parts)) for i in range(len(x))]
    return codes, [sum(last[p][i][1] for p in range(parts)) for i in range(len(x))], books


@pytest.mark.parametrize("spread,dim", [(1, 32), (0.02, 16), (5000, 64), (0, 16)])
def test_query_equals_plain_arithmetic(spark, folder, spread, dim):
    """With wide, narrow (full of ties), very large and all equal components; nulls, non-finite ones and repeated rows."""
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(150, dim)) * spread).astype(np.float32).tolist()
    rows = [(i * 3 % 150, v, [None, 1, 2, 2][i % 4], "x") for i, v in enumerate(vectors)]
    rows += [(200, vectors[0], 1, "y"), (200, vectors[0], 1, "y"), (None, vectors[1], None, "z"), (-1, None, 1, ""), (-2, [None] * dim, 1, ""), (-3, [float("nan")] * dim, 1, ""), (-4, [float("inf")] + vectors[0][1:], 1, ""), (500, [1.0], 2, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    got = Q.op12_vector_codes(spark, folder(embeddings=df)).collect()
    kept = sorted((r for r in rows if r[1] and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, books = plain([r[1] for r in kept], 16, 64, 2)
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    text = ",".join(str(c) for book in books for e in book for c in e)
    key = lambda t: tuple(str(c) for c in t)
    want = sorted(((r[0], c, e, by[r[2]], hashlib.sha256(text.encode()).hexdigest()) for r, c, e in zip(kept, codes, errors)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_intervals_hold_the_true_values():
    rng = np.random.default_rng(5)
    for scale in (10, 1 << 12, 1 << 20, 1 << 27):
        x, book = rng.integers(-scale, scale, (200, 6)), rng.integers(-scale, scale, (40, 6))
        low, high = Q.intervals(x, book)
        for i in range(len(x)):
            for k in range(len(book)):
                exact = sum(int(c) ** 2 for c in book[k]) - 2 * sum(int(a) * int(c) for a, c in zip(x[i], book[k]))
                assert low[i, k] <= exact <= high[i, k]


def test_nearest_where_float32_cannot_tell():
    """Entries one apart at 2**26, where float32 holds every eighth number: the exact step decides, and ties go to the lower index."""
    big = 1 << 26
    book = np.array([[big + 5, 0], [big + 3, 0], [big + 1, 0], [big + 3, 0], [-big, 1]])
    x = np.array([[big + 3, 0], [big + 2, 0], [big + 4, 0], [big, 0], [-big, 0]])
    entry, distance = Q.nearest(x, book)
    assert entry.tolist() == [1, 1, 0, 2, 4] and distance.tolist() == [0, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        Q.nearest(np.array([[1 << 40, 0]]), book)


def test_short_and_uncuttable_tables(spark, folder):
    ddl = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [-0.5] * 16, 1)], ddl)
    assert {(r["code"], r["error"]) for r in Q.op12_vector_codes(spark, folder(embeddings=few)).collect()} == {("00" * 16, 0), ("01" * 16, 0)}
    odd = spark.createDataFrame([(1, [0.5] * 17, 1)], ddl)
    assert Q.op12_vector_codes(spark, folder(embeddings=odd)).collect() == []
    bare = spark.createDataFrame([(1, [], 1), (2, [], 1)], ddl)
    assert [(r["code"], r["error"], r["label_error"]) for r in Q.op12_vector_codes(spark, folder(embeddings=bare)).collect()] == [("00" * 16, 0, 0)] * 2


def test_decoded_vectors_are_nearer_than_the_cells_are_wide(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32))
    rows = [(i, (centers[i % 20] + rng.normal(size=32) * 0.001).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    books = Q.fit(df)
    got = Q.encoded(df, books, ["id"]).orderBy("id").collect()
    back = Q.decoded([r["code"] for r in got], books)
    assert np.abs(back - np.array([v for _, v in rows])).max() < 0.05

"""Operator 12, vector code compression: product codes with screened exact distances.

Vectors are scaled to integers and cut into equal parts.  Each part position has a codebook,
at first the parts of the least vec_ids; some rounds assign every part to the nearest entry and move each entry to the
floor of its parts' mean; then parts are assigned for good.

The nearest entry is found by one float32 matrix product for each position: the squared
length of an entry less twice its product with the part, which orders entries as their distances do.  Every
computed value has an interval that holds the true one, from the bounds of rounding of sums of products.  Entries whose
interval overlaps that of the best are evaluated again in int64, and ties go to the lower index.

The codebooks (parts x entries x length numbers, whatever the number of vectors) go to the
tasks with the code.  A round is one pass over the table: every task sends sums and counts for its entries, which Spark adds up.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; null vec_ids come after all others, equal vec_ids
in order of their vectors; with fewer rows than entries the codebooks are as short; the length of vectors is that of the first kept row,
rows of another length are dropped, as are all if it can't be cut into equal parts; vectors of no components have codes 0 and
errors 0; repeated rows each get their row; columns may have any names; an empty table gives no rows.  Numbers so large that
squared distances overflow 64 bits are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Unit roundoff of float32.
U = 2.0**-24


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite float components; scale is a power of two, so the product is exact."""
    down = np.floor(vectors.astype(np.float64) * scale)
    if down.size and np.abs(down).max() >= 2.0**62:
        raise ValueError("components are too large for exact distances in 64 bits")
    return down.astype(np.int64)


def intervals(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|**2 - 2 x.c for parts x (n, length) and entries c (k, length), around float32 values.

    x' = x(1 + a) and c' = c(1 + b) with |a|, |b| <= U are what float32 holds of x and c, and a computed sum of m products is off
    by at most m U / (1 - m U) times the sum of the products' magnitudes, in any order of additions and with or without fused ones.  The sum
    here has length + 1 products, and each has three roundings besides its own; 2 U more covers the squared length's.
    """
    size = x.shape[1]
    left = np.concatenate([-2 * x, np.ones((len(x), 1), np.int64)], axis=1).astype(np.float32)
    squares = (book * book).sum(axis=1)
    right = np.concatenate([book, squares[:, None]], axis=1).astype(np.float32)
    value = (left @ right.T).astype(np.float64)
    m = size + 8
    gamma = m * U / (1 - m * U)
    # magnitudes in float64, made a little larger for their own roundings
    most = 2 * (np.abs(x).astype(np.float64) @ np.abs(book).astype(np.float64).T) + squares.astype(np.float64)
    error = gamma * most * (1 + 1e-9) + 1e-30
    return value - error, value + error


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part x (n, length) the lowest index of a nearest entry of book (k, length), and the squared distance; all int64."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * reach) ** 2 >= 2**63:
        raise ValueError("components are too large for exact distances in 64 bits")
    low, high = intervals(x, book)
    row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))  # by row, then by index
    exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    least = np.minimum.reduceat(exact, begin) if len(row) else exact
    hit = np.flatnonzero(exact == least[row])
    first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])] if len(hit) else hit
    return entry[first], least


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, both (n, parts), of integer vectors (n, parts * length); books is (parts, k, length)."""
    parts, _, size = books.shape
    cut = vectors.reshape(len(vectors), parts, size)
    found = [nearest(cut[:, p], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _kept(rows: DataFrame, vector: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def _vectors(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    column = batch.column("vector")
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim), scale)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, length) for rows (id, vector) without null or non-finite components; None if there are no vectors to cut."""
    # as many vectors as a codebook has entries come to the driver, however many there are
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first or len(first[0]["vector"]) % parts:
        return None
    dim = len(first[0]["vector"])
    own = rows.where(F.size("vector") == dim)
    if any(len(r["vector"]) != dim for r in first):
        first = own.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim), scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(own, books, scale)
    return books


def _moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Books with each entry at the floor of the mean of the parts nearest to it; entries without parts stay."""
    parts, k, size = books.shape

    def run(it):
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64)
        for batch in it:
            x = _vectors(batch, parts * size, scale)
            code, _ = assign(x, books)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(total[p], code[:, p], x.reshape(len(x), parts, size)[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = rows.select("vector").mapInArrow(run, "part long, entry long, n long, total array<long>")
    added = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def encoded(rows: DataFrame, books: np.ndarray | None, keep: list[str], scale: int = SCALE) -> DataFrame:
    """The columns keep, code (two hex digits a part) and error of rows with a column vector."""
    schema = T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL("code string, error long").fields])
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    parts, _, size = books.shape

    def run(it):
        for batch in it:
            code, error = assign(_vectors(batch, parts * size, scale), books)
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(text, pa.string()), pa.array(error.sum(axis=1), pa.int64())], names=[*keep, "code", "error"])

    return rows.where(F.size("vector") == parts * size).select(*keep, "vector").mapInArrow(run, schema)


def decoded(codes: list[str], books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vectors that codes stand for: the entries of their parts, at the middle of their cells."""
    at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(books))
    return (np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1) + 0.5) / scale


def digest(books: np.ndarray) -> str:
    """Of all components as decimal integers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    rows = _kept(rows, "vector")
    books = fit(rows)
    coded = encoded(rows, books, ["id", "label"])
    # as many rows as there are labels; the errors are made again, which costs less than keeping all codes
    by_label = encoded(rows, books, ["label"]).groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))


def _sql_round(name: str, book: str) -> str:
    """CTEs of one assignment to a codebook: name(r, p, e, d) with the row, part, entry and squared distance."""
    return f"""{name}d AS (SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {book} b ON b.p = x.p AND b.i = x.i GROUP BY ALL),
{name} AS MATERIALIZED (SELECT r, p, min(e) AS e, any_value(m) AS d FROM (SELECT r, p, e, d, min(d) OVER (PARTITION BY r, p) AS m FROM {name}d) WHERE d = m GROUP BY r, p)"""


def _sql_book(name: str, before: str, assigned: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.v) AS v FROM {before} b LEFT JOIN
  (SELECT x.p, a.e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN {assigned} a ON a.r = x.r AND a.p = x.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.i = b.i)"""


#: Holds for vectors of one length, which 16 divides.
ORACLE = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) - 1 AS j, len(w) // 16 AS q FROM k),
x AS MATERIALIZED (SELECT r, j // q AS p, j % q AS i, CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM f),
b0 AS MATERIALIZED (SELECT p, r AS e, i, v FROM x WHERE r < 64),
{_sql_round("a0", "b0")},
{_sql_book("b1", "b0", "a0")},
{_sql_round("a1", "b1")},
{_sql_book("b2", "b1", "a1")},
{_sql_round("a2", "b2")},
c AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
g AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, g.h AS codebooks_sha256 FROM k JOIN c ON c.r = k.r, g
"""

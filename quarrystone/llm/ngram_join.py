"""Operator 11, n-gram Jaccard join by grouped prefixes.

A text's set is its distinct shingles of four words.  Two sets that overlap by the threshold share one of the first few
shingles of each, in any order that holds for all sets; here rare shingles come first, so
that most texts have nothing to share.  In how many texts a shingle occurs is asked through ``exchange``: blocks of texts send each part of the
key space their distinct shingles once.  Equal texts in one block count once; others may count more
often, which changes the order, but not what the join finds.  A shingle that no other text has can't be shared and is left out of the prefix.

Texts with the same prefix and size are one group.  Groups are joined on the shingles of their prefixes, and pairs of groups are filtered by sizes
and by the places of the shared shingle.  Pairs are not listed within a bucket: first every group is paired with two pivots of each of its buckets
(the group with the earliest place, which has the fewest shingles of its own, and one by a hash), and the texts of a group with their first.  These pairs
are verified by exact intersection, and links make components.  Then, in buckets and groups that still hold several components, every
pair of units (the texts of a group in one component) of two components, one of them not the commonest of the bucket, is expanded to its texts and verified.
What is left out are pairs that lie in one component already, so components are those of all links.

Shingles are compared by 64-bit hashes.

Defined results: texts of fewer than four words have one shingle, the whole text; null and empty texts, and those of white space, have none, and are each a
component of their own; rows with equal texts are one component; a component's id is the least doc_id of its rows (null if none has one); rows that
share a doc_id are taken one by one; very long texts are taken whole; columns of docs may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .bagminhash import components
from .common import batches, materialise, release, rolling, table, word_hashes

SHINGLE, PERCENT = 4, 85


def shingles_of(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k words, A-Z in lower case; of the whole text if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(rolling(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n hold one of every set that overlaps it by percent: all but the least overlap, and one."""
    return n - -(-percent * n // 100) + 1


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the Jaccard similarity of two sorted sets is percent or more, in whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def allowed(n: Column, q: Column, n2: Column, q2: Column, percent: int) -> Column:
    """Whether sets of n and n2 shingles whose first common one is at places q and q2 can overlap by percent: none before it is common."""
    most = F.least(n - q, n2 - q2)
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((100 + percent) * most >= percent * (n + n2))


class Block:
    """The texts of a block: each row's set, and the first row of each distinct text."""

    def __init__(self, pdf: pd.DataFrame, k: int, shift: int):
        texts = pdf["text"].tolist()
        self.nodes = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if t is not None else None for t in texts]
        first: dict[bytes | None, int] = {}
        self.first = [first.setdefault(node, i) for i, node in enumerate(self.nodes)]
        self.sets = [shingles_of(t, k) if f == i else np.empty(0, np.uint64) for i, (t, f) in enumerate(zip(texts, self.first, strict=True))]
        every = np.concatenate([np.empty(0, np.uint64), *self.sets])
        self.keys, self.of, self.counts = np.unique(every >> np.uint64(shift), return_inverse=True, return_counts=True)
        self.shift = np.uint64(shift)


def prefixes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, node and n for each row of docs (doc_id, text); grp, tokens, places and packed (the set) for the first row of a text in a block, if its prefix holds shingles that other rows have.

    node is a digest of the text (null without words), grp one of size and prefix.  Shingles are counted by so many first bits of their
    hashes that few share them; what is taken for common by mistake only costs time.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    total = X.text_bytes(rows)
    blocks = parts = X.n_blocks(rows, total, block_bytes)
    shift = 64 - max(32, min(64, math.ceil(math.log2(total + 1)) + 5))
    by_block = rows.select(F.pmod("h", F.lit(blocks)).alias("block"), "doc_id", "text").groupBy("block")

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, k, shift)
        asked = [(p, key[0], X.pack(X.steps(b.keys[i:j]), b.counts[i:j].astype(np.uint32))) for p, i, j in X.shares(b.keys << b.shift, parts)]
        return pd.DataFrame(asked, columns=["part", "block", "data"])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [(np.cumsum(s, dtype=np.uint64), c) for s, c in (X.unpack(d, np.uint64, np.uint32) for d in pdf["data"])]
        _, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        found = np.bincount(at, np.concatenate([a[1] for a in asked]))[at].astype(np.uint64)
        ends = np.cumsum([len(a[0]) for a in asked])
        data = [X.pack(found[e - len(a[0]) : e]) for a, e in zip(asked, ends, strict=True)]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "part": key[0], "data": data})

    def cut(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, k, shift)
        common = np.concatenate([np.empty(0, np.uint64), *[X.unpack(d, np.uint64)[0] for _, d in sorted(zip(got["part"], got["data"], strict=True))]])[b.of]
        made, begin = [], 0
        for doc_id, node, first, own in zip(pdf["doc_id"], b.nodes, b.first, b.sets, strict=True):
            n = len(b.sets[first])
            found, begin = common[begin : begin + len(own)], begin + len(own)
            row = [None if pd.isna(doc_id) else int(doc_id), node if n else None, n, None, None, None, None]
            if len(own):
                order = np.lexsort((own, found))[: prefix_length(n, percent)]
                places = np.flatnonzero(found[order] > 1)
                if len(places):
                    row[3:] = xxhash.xxh3_128_digest(own[order].tobytes() + n.to_bytes(8)), own[order[places]].view(np.int64).tolist(), places.tolist(), own.tobytes()
            made.append(row)
        return pd.DataFrame(made, columns=["doc_id", "node", "n", "grp", "tokens", "places", "packed"], dtype=object)

    counted = by_block.applyInPandas(ask, "part int, block long, data binary").groupBy("part").applyInPandas(count, "block long, part int, data binary")
    return by_block.cogroup(counted.groupBy("block")).applyInPandas(cut, "doc_id long, node binary, n long, grp binary, tokens array<long>, places array<int>, packed binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of distinct pairs (a, b) whose sets link; sets: node, packed."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(sets.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b").select("a", "b", "pa", "pb")

    def run(batch: pa.RecordBatch):
        of = [[np.frombuffer(p, np.uint64) for p in batch.column(i).to_pylist()] for i in (2, 3)]
        yield batch.select([0, 1]).filter(pa.array([links(x, y, percent) for x, y in zip(*of, strict=True)], pa.bool_()))

    return both.mapInArrow(batches(run), "a binary, b binary")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def starred(groups: DataFrame, members: DataFrame, keyed: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct pairs (a, b) of a group's first text with its others, and of the first texts of two pivots of each bucket with those of the bucket's groups; and frames to release."""
    near, far = F.struct("q", F.xxhash64("key", "grp").alias("h"), "grp", "first", "n"), F.struct(F.xxhash64("key", "grp").alias("h"), "q", "grp", "first", "n")
    picked = keyed.groupBy("key").agg(F.min(near).alias("near"), F.min(far).alias("far"))
    same = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("q", "grp", "first", "n")])
    pivots = materialise(picked.select("key", F.explode(F.array_distinct(F.array(same("near"), same("far")))).alias("p")), "pivots")
    met = keyed.join(pivots, "key").where((F.col("grp") != F.col("p.grp")) & allowed(F.col("n"), F.col("q"), F.col("p.n"), F.col("p.q"), percent))
    own = members.join(groups.where("size > 1").select("grp", "first"), "grp").where(F.col("node") != F.col("first"))
    pairs = met.select(*_pair("first", "p.first")).unionByName(own.select(*_pair("first", "node"))).distinct()
    return pairs, [pivots]


def apart(rows: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct pairs of units (g, r, g2, r2) that share a key and may link, of two components; and frames to release.

    rows: key, grp, root, n, q.  Of the components of a key the one with most units is its main one; of two units of different components
    at least one is not of the main one, so those alone are joined with the others.
    """
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = materialise(sizes.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main"), "mixed")
    held = materialise(rows.join(mixed, "key"), "units")
    other = held.select("key", *[F.col(c).alias(f"{c}2") for c in ("grp", "root", "n", "q")])
    met = held.where(F.col("root") != F.col("main")).join(other, "key").where((F.col("root") != F.col("root2")) & allowed(F.col("n"), F.col("q"), F.col("n2"), F.col("q2"), percent))
    one, two = F.struct(F.col("grp").alias("g"), F.col("root").alias("r")), F.struct(F.col("grp2").alias("g"), F.col("root2").alias("r"))
    met = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return met.select("x.g", "x.r", F.col("y.g").alias("g2"), F.col("y.r").alias("r2")), [mixed, held]


def roots_of(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, root of every node that links to another; found: prefixes().  Its files are the caller's to release."""
    sets = materialise(found.where(F.col("grp").isNotNull()).groupBy("node").agg(*[F.first(c).alias(c) for c in ("grp", "n", "tokens", "places", "packed")]), "sets")
    members = sets.select("grp", "node")
    groups = materialise(sets.groupBy("grp").agg(F.min("node").alias("first"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("places").alias("places"), F.count(F.lit(1)).alias("size")), "groups")
    every = groups.select("grp", "first", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("grp", "first", "n", F.col("t.tokens").alias("key"), F.col("t.places").alias("q"))
    several = materialise(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    keyed = materialise(every.join(several, "key"), "keyed")
    pairs, frames = starred(groups, members, keyed, percent)
    tested = materialise(pairs, "pairs")
    linked = materialise(verified(tested, sets, percent), "links")
    roots = components(linked)
    named = materialise(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    units = named.select("grp", "root").distinct()
    by_token, more = apart(keyed.select("key", "grp", "n", "q").join(units, "grp"), percent)
    by_group, most = apart(units.select(F.col("grp").alias("key"), "grp", "root", F.lit(1).alias("n"), F.lit(0).alias("q")), percent)
    left = materialise(by_token.unionByName(by_group).distinct(), "left")
    of = named.select(F.col("grp").alias("g"), F.col("root").alias("r"), F.col("node").alias("x"))
    of2 = named.select(F.col("grp").alias("g2"), F.col("root").alias("r2"), F.col("node").alias("y"))
    rest = materialise(left.join(of, ["g", "r"]).join(of2, ["g2", "r2"]).select(*_pair("x", "y")).join(tested, ["a", "b"], "left_anti"), "pairs")
    later = materialise(verified(rest, sets, percent), "links")
    frames += [groups, several, keyed, tested, linked, named, *more, *most, left, rest]
    if later.limit(1).count():
        earlier, roots = roots, components(later.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        frames.append(earlier)
    for frame in [*frames, sets, later]:
        release(frame)
    return roots


def joined(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    found = materialise(prefixes(docs, percent, k), "prefixes")
    roots = roots_of(found, percent)
    named = found.select("doc_id", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that Spark can split the rows of a large component over tasks
    least = materialise(named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    made = named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    made = materialise(made, "components")
    for frame in (found, roots, least):
        release(frame)
    return made


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
t AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE 100 * m >= 85 * (ta.n + tb.n - m)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
k AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT k.doc_id, coalesce(t.n, 0) AS n_shingles, k.component_id FROM k LEFT JOIN t ON t.doc_id = k.doc_id
"""

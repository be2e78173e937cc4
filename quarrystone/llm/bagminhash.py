"""Operator 9, MinHash near-dedup by BagMinHash.

A text is a bag: its shingles of five words with their counts.  Every shingle has
Poisson processes over its count axis, cut into the bands (0,1], (1,2], (2,4], (4,8] ...
whose rates are their widths; a band inside the count is taken whole, the one that the
count ends in is halved again and again, each point going to a half by its next random
bit, and only halves inside the count are kept.  A point has a time and one of the
signature's places; a place keeps the shingle of its earliest point.  Points come in
order of time, so a process is left as soon as it is later than every place's
earliest, and long texts cost little more than their shingles.  Two signatures agree at a place with the
probability of the weighted Jaccard similarity (sum of least over sum of greatest counts).

Signatures are cut into bands; texts that share a band are in a bucket.  In every bucket a
few pivots are verified against the others by exact multiset overlap, in two turns, which
brings most copies together.  In buckets that still hold several components, every pair of
nodes of two components is then verified, but for pairs that sizes, distances to
the bucket's center or parities of the bags rule out; all these bounds are exact.  Exact copies are one
text from the start.  The links' components are found by repeated least labels, with the
labels' shortcuts.

Defined results: texts of fewer than five words have one shingle, the whole text; null
and empty texts, and those of white space, have none and are each a class of their own; equal texts are one class;
a class id is the least doc_id of its documents (null if none has one); very long texts are taken whole; columns of
docs may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, batches, materialise, mix, release, rolling, word_hashes, words_of

SHINGLE, BANDS, ROWS = 5, 24, 4
TURNS = 2  # turns of pivots before all pairs of components
FEW, CHUNK, BITS = 32, 512, 2048
SALT = 1000  # nodes of a bucket that one task joins with what its bucket is told


def _salted(df: DataFrame) -> DataFrame:
    """df (bucket, node, n) with salt: a bucket of n nodes is dealt over n / SALT tasks."""
    return df.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SALT)))


def _told(df: DataFrame, n: str = "n") -> DataFrame:
    """df (bucket, n) once for each of its bucket's salts, without n."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / SALT) - 1))).drop(n)


def bag_of_words(words: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes (sorted) and their counts."""
    shingles = rolling(word_hashes(words), min(k, len(words))) if words else np.empty(0, np.uint64)
    return np.unique(shingles, return_counts=True)


def bag_of(text: str | None, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return bag_of_words(words_of(text), k)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][x], b[1][y]).sum())
    return least / (total - least)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """For each bag (none empty) the shingle that holds each of size places."""
    sizes = np.array([len(k) for k, _ in bags])
    keys, counts = np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    total = np.array([c.sum() for _, c in bags], float)
    # processes: shingle, band number, width of the band, and how far into the band the count reaches
    own, band, width, inside = [np.arange(len(keys))], [np.zeros(len(keys), np.uint64)], [np.ones(len(keys))], [np.ones(len(keys))]
    many, low, no = np.flatnonzero(counts > 1), 1, 1
    while len(many):
        own.append(many)
        band.append(np.full(len(many), no, np.uint64))
        width.append(np.full(len(many), float(low)))
        inside.append(np.minimum(counts[many] - low, low).astype(float))
        low, no = 2 * low, no + 1
        many = many[counts[many] > low]
    own, band, width, inside = map(np.concatenate, (own, band, width, inside))
    seed = mix(keys[own] + (band + np.uint64(1)) * BASE)
    where = doc[own]
    limit = size / total * (np.log(size) + 2.0)
    winners = np.zeros(len(bags) * size, np.uint64)
    todo = np.ones(len(bags), bool)
    while todo.any():  # the limit is mostly late enough; twice as late for a bag with an empty place
        times = np.full(len(bags) * size, np.inf)
        at = np.flatnonzero(todo[where])
        now, state, late = np.zeros(len(at)), seed[at], np.where(todo, limit, 0.0)
        step = np.uint64(0)
        while len(at):
            step = np.uint64((int(step) + int(BASE)) & 0xFFFFFFFFFFFFFFFF)
            draw = mix(state + step)
            now = now - np.log(_uniform(draw)) / width[at]
            alive = np.flatnonzero(now <= late[where[at]])
            at, now, state, draw = at[alive], now[alive], state[alive], draw[alive]
            bits = mix(draw ^ BASE)
            # halving the band down to single counts: the point's unit is the number that its random bits spell
            wide = np.flatnonzero(width[at] > 1)
            unit = np.floor((bits[wide] >> np.uint64(24)).astype(np.float64) * 2.0**-40 * width[at[wide]])
            kept = np.ones(len(at), bool)
            kept[wide] = unit < inside[at[wide]]
            kept = np.flatnonzero(kept)
            place = (((bits[kept] & np.uint64(0xFFFFFF)) * np.uint64(size)) >> np.uint64(24)).astype(np.int64) + where[at[kept]] * size
            t = now[kept]
            np.minimum.at(times, place, t)
            first = np.flatnonzero(t == times[place])
            winners[place[first]] = keys[own[at[kept[first]]]]
            late = np.minimum(late, times.reshape(-1, size).max(axis=1))
        todo &= ~np.isfinite(times.reshape(-1, size)).all(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    return winners.reshape(-1, size)


def band_keys(texts: list[str | None], bands: int, rows: int, at_once: int = 100_000) -> list[list[int]]:
    """A hash for each band of each text's signature; none for a text without words.

    Signatures are made for runs of texts of about at_once shingles together.
    """
    out: list[list[int]] = []
    run: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    held = 0

    def flush() -> None:
        sig = mix(signatures([b for _, b in run], bands * rows)).reshape(-1, bands, rows)
        h = np.tile(np.arange(bands, dtype=np.uint64), (len(run), 1))
        for j in range(rows):
            h = mix(h * BASE + sig[:, :, j])
        for (i, _), keys in zip(run, h.view(np.int64).tolist(), strict=True):
            out[i] = keys
        run.clear()

    for text in texts:
        out.append([])
        words = words_of(text)
        if words:
            bag = bag_of_words(words)
            run.append((len(out) - 1, bag))
            held += len(bag[0])
        if held >= at_once:
            flush()
            held = 0
    if run:
        flush()
    return out


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """node, size (its shingles with their counts) and bands for each row of docs (node, text)."""

    def run(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        sizes = [max(1, len(words_of(t)) - SHINGLE + 1) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(band_keys(texts, bands, rows), pa.list_(pa.int64()))], names=["node", "size", "bands"])

    return docs.select("node", "text").mapInArrow(batches(run), "node binary, size long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of distinct pairs (a, b) of nodes; texts has a row for each node."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batch: pa.RecordBatch):
        bags: dict = {}  # texts repeat within a batch: a pivot meets many

        def bag(node, text):
            if node not in bags:
                bags[node] = bag_of(text)
            return bags[node]

        cols = [batch.column(i).to_pylist() for i in range(4)]
        found = [overlap(bag(a, ta), bag(b, tb)) for a, b, ta, tb in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(batches(run), "a binary, b binary, similarity double")


SHARE = 200_000  # edges that one task contracts


def _contract(it):
    """Each node of a share of edges (a, b) with the least node that it reaches within the share."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node of its component.

    Edges are first contracted in shares of SHARE, in any order.  With one share that is all.  With more,
    each round a node takes the least label among itself and its neighbours, then its
    label's label, so that chains shorten, until no label moves; labels are written each round.
    """
    shares = max(1, -(-edges.count() // SHARE))
    stars = materialise(edges.select("a", "b").repartition(shares).mapInArrow(_contract, "a binary, b binary"), "stars")
    if shares == 1:
        roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        roots.written_to = stars.written_to
        return roots
    both = materialise(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        own = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("root").alias("further"))
        fresh = own.join(jump, "least", "left").select("node", F.least("least", F.coalesce("further", "least")).alias("root"), (F.least("least", F.coalesce("further", "least")) < F.col("root")).alias("moved"))
        fresh = materialise(fresh, "labels")
        release(labels)
        labels = fresh
        if not fresh.where("moved").limit(1).count():
            release(both)
            release(stars)
            roots = fresh.select("node", "root")
            roots.written_to = fresh.written_to
            return roots


def candidates(members: DataFrame, turn: int, pivots: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's pivots with its members of other components.

    members: bucket, n (its nodes), node, size, center, near, root and main, the component with most members of the
    bucket.  In the first turn every node is a component of its own, and the pivots are the
    center and others by a hash of bucket, node and turn, so that a node meets different ones
    in its buckets.  In later turns they are four times as many, half of them of the main
    component, and meet only members outside it.  One less the similarity is a distance, so
    two nodes whose similarities to the center (near) differ by more than one less the
    threshold cannot be linked, and are left out, as are those whose sizes are too far apart.
    """
    inside = F.col("root") == F.col("main")
    n = pivots if turn == 0 else 4 * pivots
    picks = []
    for i in range(n):
        pick = F.struct(F.xxhash64(F.lit(turn * 1000 + i), "bucket", "node").alias("h"), "node", "root", "near", "size")
        picks.append(F.min(pick if turn == 0 else F.when(inside if i % 2 else ~inside, pick)).alias(f"p{i}"))
    if turn == 0:
        picks[0] = F.max(F.when(F.col("node") == F.col("center"), F.struct(F.lit(0).cast("long").alias("h"), "node", "root", "near", "size"))).alias("p0")
    drawn = F.array(*[F.struct(*[F.col(f"p{i}.{c}").alias(c) for c in ("node", "root", "near", "size")]) for i in range(n)])
    chosen = _told(members.groupBy("bucket").agg(*picks, F.max("n").alias("n")).select("bucket", "n", F.explode(F.array_distinct(drawn)).alias("p")))
    met = _salted(members if turn == 0 else members.where(~inside)).join(chosen, ["bucket", "salt"]).where(F.col("root") != F.col("p.root"))
    met = met.where(F.least("size", "p.size") >= threshold * F.greatest("size", "p.size") - 1e-9)
    met = met.where(F.coalesce(F.abs(F.col("near") - F.col("p.near")) <= 1 - threshold + 1e-9, F.lit(True)))
    return met.select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).distinct()


def parities(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """BITS bits, each flipped by every shingle of the bag, as often as it counts, that falls on it.

    Two bags' bits differ in no more places than the bags differ in shingles.
    """
    keys, counts = bag
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = mix(np.repeat(keys, counts) + nth.astype(np.uint64) * BASE) & np.uint64(BITS - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def close_pairs(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs (a, b) of other components that size, distance to the center and parities allow, between two chunks of a bucket or within one."""
    node, chunk = pdf["node"].to_numpy(), pdf["chunk"].to_numpy()
    root, size, near, inside = pd.factorize(pdf["root"])[0], pdf["size"].to_numpy(), pdf["near"].to_numpy(float), pdf["inside"].to_numpy(bool)
    bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
    within = pdf["low"].iat[0] == pdf["high"].iat[0]
    out = []
    for x in np.flatnonzero(~inside):  # of two components one is not the main one
        far = (root == root[x]) | (np.minimum(size, size[x]) < threshold * np.maximum(size, size[x]) - 1e-9)
        far |= np.nan_to_num(np.abs(near - near[x])) > 1 - threshold + 1e-9
        if not within:
            far |= chunk == chunk[x]
        y = np.flatnonzero(~far)
        y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1) <= (1 - threshold) / (1 + threshold) * (size[y] + size[x]) + 1e-9]
        out += [(min(node[x], n), max(node[x], n)) for n in node[y]]
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"])


def remaining(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of all nodes of a bucket that are of two components and not ruled out.

    Buckets of up to FEW nodes are joined with themselves.  Larger ones are dealt in chunks of about
    CHUNK nodes, and every two chunks are compared in one task, by the parities of their bags.
    """
    members = members.select("bucket", "n", "node", "root", "size", "near", (F.col("root") == F.col("main")).alias("inside"))
    small = members.where(F.col("n") <= FEW)
    other = small.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "size", "near")])
    met = small.where(~F.col("inside")).join(other, "bucket").where(F.col("root") != F.col("root2"))
    met = met.where(F.least("size", "size2") >= threshold * F.greatest("size", "size2") - 1e-9)
    met = met.where(F.coalesce(F.abs(F.col("near") - F.col("near2")) <= 1 - threshold + 1e-9, F.lit(True)))
    met = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([parities(bag_of(t)) for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "bits"])

    large = members.where(F.col("n") > FEW)
    bits = texts.join(large.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(batches(run), "node binary, bits binary")
    chunks = F.ceil(F.col("n") / CHUNK)
    dealt = large.join(bits, "node").withColumns({"chunk": F.pmod(F.xxhash64("node"), chunks), "k": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    dealt = dealt.select("bucket", F.least("chunk", "k").alias("low"), F.greatest("chunk", "k").alias("high"), "chunk", "node", "root", "size", "near", "inside", "bits")
    found = dealt.groupBy("bucket", "low", "high").applyInPandas(lambda pdf: close_pairs(pdf, threshold), "a binary, b binary")
    return met.unionByName(found).distinct()


def linked(buckets: DataFrame, texts: DataFrame, threshold: float, pivots: int) -> DataFrame | None:
    """node, root of every node with a link; buckets: bucket, n, node, size, center, for buckets of two or more.

    TURNS turns compare pivots of the buckets that still hold several components with their
    members of other components, which brings most copies together.  Then all pairs of
    components that are left in a bucket are compared, but for those that are ruled out.
    """
    members = buckets.withColumns({"near": F.lit(None).cast("double"), "root": F.col("node"), "main": F.lit(None).cast("binary")})
    roots, tested, done = None, None, []
    for turn in range(TURNS + 1):
        pairs = candidates(members, turn, pivots, threshold) if turn < TURNS else remaining(members, texts, threshold)
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        seen = materialise(verified(pairs, texts), "similarities")
        done += [pairs, seen]
        found = seen.where(F.col("similarity") >= threshold).select("a", "b")
        if found.limit(1).count():
            before = roots
            roots = components(found if roots is None else found.union(roots.select("node", "root")))
            if before is not None:
                release(before)
        if turn == TURNS:
            for frame in [*done, members]:
                release(frame)
            return roots
        tested = pairs if tested is None else tested.unionByName(pairs)
        held = members.select("bucket", "n", "node", "size", "center", "near")  # a bucket of one component stays so
        if turn == 0:
            to_center = seen.select("a", "b", F.col("similarity").alias("s"))
            held = held.withColumns({"a": F.least("node", "center"), "b": F.greatest("node", "center")}).join(to_center, ["a", "b"], "left").withColumn("near", F.when(F.col("node") == F.col("center"), 1.0).otherwise(F.col("s"))).drop("a", "b", "s")
        named = held.withColumn("root", F.col("node")) if roots is None else held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("of_root"), F.max("n").alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("of_root", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where("k > 1").select("bucket", "n", "main")
        earlier, members = members, materialise(_salted(named).join(_told(mixed), ["bucket", "salt"]).drop("salt"), "members")
        release(earlier)


def _node():
    """The node of a text: one for all its copies, none without words."""
    return F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.unhex(F.md5("text")))


def rooted(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, pivots: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and node for each row of docs (doc_id, text); and node, root of the nodes with a link."""
    docs = docs.select("doc_id", "text", _node().alias("node"))
    member, texts = docs.select("doc_id", "node"), docs.where(F.col("node").isNotNull()).select("node", "text")
    # one node for all copies of a text
    nodes = materialise(sketches(texts, bands, rows).groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands")), "bands")
    buckets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    several = materialise(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = materialise(buckets.join(several, "bucket"), "buckets")
    degree = materialise(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    few = materialise(texts.join(degree.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    # a bucket's center is the node that shares most buckets with others: nearest to the middle of its copies
    ranked = materialise(shared.join(degree, "node").select("bucket", "n", "node", "size", "degree"), "ranked")
    centers = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("center"), F.max("n").alias("n"))
    centered = materialise(_salted(ranked).join(_told(centers), ["bucket", "salt"]).select("bucket", "n", "node", "size", "center"), "buckets")
    for frame in (nodes, several, shared, degree, ranked):
        release(frame)
    roots = linked(centered, few, threshold, pivots)
    for frame in (centered, few):
        release(frame)
    return member, roots


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size for each row of docs (doc_id, text)."""
    member, roots = rooted(docs, **options)
    if roots is None:
        named = member.withColumn("root", F.col("node"))
    else:
        named = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = F.col("root").isNull()
    return named.select("doc_id", "root").join(sizes, "root", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).alias("class_size"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """A row of docs for each class: that with the least doc_id (of several texts under it, the least node), or any one if none has an id.

    Of rows equal in both the one with the least hash of all its columns stays.  Rows without words are a class each
    and all stay, but for repeated ones under one doc_id.
    """
    _, roots = rooted(docs.select("doc_id", "text"), **options)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", _node().alias("node"))
    named = held.where(F.col("node").isNotNull()).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a null id is the least of all, so whether it is null comes first
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "n")).alias("f")).select("f.doc_id", "f.node", "f.n")

    def rows(of: DataFrame) -> DataFrame:
        of = of.select(F.col("doc_id").alias("first_id"), F.col("node").alias("first_node"))
        return held.join(of, (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")

    kept = rows(first.where("n = 1")).unionByName(rows(first.where("n > 1")).groupBy("doc_id", "node").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc", "doc_id", "node"))
    blank = held.where(F.col("node").isNull())
    again = blank.where(F.col("doc_id").isNotNull()).withColumn("text", F.col("doc.text")).dropDuplicates(["doc_id", "text"]).drop("text")
    kept = kept.unionByName(again).unionByName(blank.where(F.col("doc_id").isNull()))
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS MATERIALIZED (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS m FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE m >= 0.8 * (ta.n + tb.n - m)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
k AS (SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM k
"""

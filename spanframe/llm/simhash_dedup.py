"""SimHash near-duplicates: exact Hamming neighbours by a vantage-point tree whose leaves are shards.

A document's fingerprint has 192 bits over its pairs of neighbouring words (case and ASCII punctuation don't count; a
single word is its own feature). The distance of two fingerprints is their Hamming distance, whatever the texts' lengths; it
is a metric, so the triangle bounds of the tree hold for it, though they cut off little at this radius: mostly the tree has
one leaf. Within a pair of blocks near() finds the pairs by chunks of bits of which one must be close: exact, for a share of all pairs. Pairs at most RADIUS apart are near-duplicates; a group is what pairs connect.
Equal fingerprints are one until the end, so copies are never expanded into pairs; a document's links count them all the same.

Defined results: a null, empty or wordless text has no fingerprint and is in no group; documents with the same words are
one fingerprint and so at distance 0, however many and however long. Rows that repeat a doc_id are one document for
near_duplicates(), with all their texts; drop_near_duplicates() looks at each row's own text, so of rows with one doc_id those
stay whose texts are in no common group. Ties of a group go to the smallest doc_id, then the smallest fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import U64, cut, fold_bytes, fresh, mix, text_bytes, text_chunks, trim, words
from spanframe.llm.components import components

WORDS = 3
BITS = 64 * WORDS
#: Near copies with some 4 % of their words changed differ in about 25 +- 5 bits, unrelated texts in 94 +- 7.
RADIUS = 40
#: Fingerprints that the tree is fitted on. It decides how well the shards are balanced, never which pairs are found.
TREE_SAMPLE = 8192
#: Rows of a shard that one task compares at once; larger shards are cut into pairs of blocks, all of which are compared.
BLOCK = 1 << 19
#: Tasks at least, where there are so few pairs of blocks that each is shared by up to PARTS.
SPREAD, PARTS = 36, 12
#: Partitions of the comparing stage, at most.
MANY = 1 << 13
#: What a bucket's tile and a gathered row cost, in compared pairs.
CALL, GATHER = 25_000, 6
#: Pairs that are compared at once, and columns at most; what that takes fits a core's cache.
TILE, COLUMNS = 1 << 15, 2048
FINGER = [f"f{w}" for w in range(WORDS)]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x WORDS) fingerprints and each row's number of words."""
    out, count = np.zeros((len(texts), WORDS), U64), np.zeros(len(texts), np.int64)
    for at, part in text_chunks(texts):
        data, offs = text_bytes(part)
        s, _, row, h = words(fold_bytes(data), offs)
        n = len(part)
        count[at:at + n] = k = np.bincount(row, minlength=n)
        if not len(s):
            continue
        pair = row[1:] == row[:-1]
        f = np.concatenate([mix(h[:-1] * U64(3) + h[1:])[pair], h[k[row] == 1]])
        r = np.concatenate([row[:-1][pair], row[k[row] == 1]])
        total = np.bincount(r, minlength=n)
        for w in range(WORDS):
            bytes_ = mix(f + U64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                seen = np.bincount(r * 256 + bytes_[:, j], minlength=n * 256).reshape(n, 256).astype(np.float32)
                ones = (2 * (seen @ _BITS) > total[:, None]).astype(U64)
                out[at:at + n, w] |= (ones << np.arange(8, dtype=U64)).sum(1, dtype=U64) << U64(8 * j)
    return out, count


def _fingerprint(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        f, n = fingerprints(texts)
        f = f.view(np.int64)
        yield pa.StructArray.from_arrays([*(pa.array(f[:, w].copy()) for w in range(WORDS)), pa.array(n.astype(np.int32))], ["f0", "f1", "f2", "n"])
        del texts
        trim()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a to all rows of b."""
    d = np.zeros((len(a), len(b)), np.uint8)
    for w in range(WORDS):
        d += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return d.astype(np.int64)


class VpTree:
    """A tree of (vantage point, ball radius) splits; a leaf is a shard. Built on a sample, it holds for any fingerprint."""

    def __init__(self, f: np.ndarray, leaf: int, radius: float, seed: int = 0):
        self.radius, self.leaves, self.nodes = radius, 0, []
        self.rng = np.random.default_rng(seed)
        self.root = self._build(f, leaf)

    def _build(self, f: np.ndarray, leaf: int) -> int:
        if len(f) > leaf:
            # The best vantage point is the one that leaves the fewest sample points in both branches: an outlying one.
            tries = np.unique(self.rng.integers(0, len(f), 8))
            best = None
            for d, t in zip(distances(f[tries], f), tries):
                mu = float(np.median(d))
                both = int((np.abs(d - mu) <= self.radius).sum())
                if (d <= mu).any() and (d > mu).any() and (best is None or both < best[0]):
                    best = both, t, mu, d
            if best and best[0] < 0.9 * len(f):
                _, t, mu, d = best
                k = len(self.nodes)
                self.nodes.append(None)
                inner = self._build(f[d <= mu], leaf)
                outer = self._build(f[d > mu], leaf)
                self.nodes[k] = (f[t:t + 1].copy(), mu, inner, outer)
                return k
        self.leaves += 1
        return -self.leaves

    def route(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each leaf that a row's ball can reach; home: the leaf that the row itself is in."""
        rows, leaves, home = [], [], []
        todo = [(self.root, np.arange(len(f)), np.ones(len(f), bool))]
        while todo:
            k, r, own = todo.pop()
            if not len(r):
                continue
            if k < 0:
                rows.append(r), leaves.append(np.full(len(r), -k)), home.append(own)
                continue
            vantage, mu, inner, outer = self.nodes[k]
            d = distances(vantage, f[r])[0]
            go = d - self.radius <= mu
            todo.append((inner, r[go], own[go] & (d[go] <= mu)))
            go = d + self.radius > mu
            todo.append((outer, r[go], own[go] & (d[go] > mu)))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(home)


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (in a, in b) at most radius apart, and their distances. same: a is b, and each pair of two rows comes once.
    part, of parts: only a share of them; together the parts give each pair once.

    The bits are cut into chunks, each with a limit; if a pair is over the limit of every chunk, its distance is over the sum of
    (limit + 1), which is more than radius (Qin et al., 2018, "GPH"). So for each chunk only rows whose bits there are within its
    limit are compared, in tiles of buckets, and a pair is given by the first chunk that finds it. Where the buckets hold so much of
    the rows that this saves nothing, all pairs are compared.
    """
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    pairs = a.shape[1] * b.shape[1] / (1 + same)
    chunks = _chunks(a.shape[1], b.shape[1], radius, pairs)
    if len(chunks) < 2:
        yield from _dense(a, b, radius, same, part, parts)
        return
    plan, work = [], 0
    for at, bits, most in chunks:
        masks = _masks(bits, most)
        ka, kb = _bits_at(a, at, bits), _bits_at(b, at, bits)
        na, nb = np.bincount(ka, minlength=1 << bits), np.bincount(kb, minlength=1 << bits)
        every = np.arange(1 << bits)
        work += sum(int(na @ nb[every ^ m]) for m in masks) / (1 + same) + np.count_nonzero(na) * CALL
        plan.append((masks, na, nb))
    if work > pairs:
        yield from _dense(a, b, radius, same, part, parts)
        return
    room = _room()
    for k, (masks, na, nb) in islice(enumerate(plan), part, None, parts):
        ka, kb = (_bits_at(z, *chunks[k][:2]) for z in (a, b))
        ra, rb = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        sa, sb = np.ascontiguousarray(a[:, ra]), np.ascontiguousarray(b[:, rb])
        ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
        for v in np.flatnonzero(na):
            other = v ^ masks
            other = other[nb[other] > 0]
            if same:
                other = other[other >= v]
            size = nb[other]
            total = int(size.sum())
            if not total:
                continue
            # The rows of b's buckets one after another.
            rows = np.arange(total) + np.repeat(ends_b[other] - np.cumsum(size), size)
            x0, x1 = ends_a[v] - na[v], ends_a[v]
            for x, y, d in _dense(sa[:, x0:x1], np.take(sb, rows, 1), radius, room=room):
                x, y = x0 + x, rows[y]
                ok = np.ones(len(x), bool)
                if same:
                    ok = (ka[ra[x]] != kb[rb[y]]) | (x < y)
                x, y = ra[x], rb[y]
                for at, bits, most in chunks[:k]:
                    ok &= np.bitwise_count(_bits_at(a[:, x], at, bits) ^ _bits_at(b[:, y], at, bits)) > most
                if ok.any():
                    yield x[ok], y[ok], d[ok]


def _room() -> tuple[np.ndarray, ...]:
    """What _dense() works in."""
    return tuple(np.empty(TILE, kind) for kind in (U64, np.uint8, np.uint8, bool))


def _dense(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, part: int = 0, parts: int = 1, room: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """near() by comparing all columns of a with all of b. All but the last word decide for nearly all pairs, as those of
    unrelated texts alone are further apart."""
    if not b.shape[1]:
        return
    # Tiles as wide as a whole number of eight bytes: where eight pairs at once are too far, none of them is looked at.
    cols = min(COLUMNS, -(-b.shape[1] // 8) * 8)
    rows = TILE // cols
    xor, count, more, close = (z[:rows * cols].reshape(rows, cols) for z in room or _room())
    for at in range(part * rows, a.shape[1], parts * rows):
        to = min(a.shape[1], at + rows)
        for x in range(at if same else 0, b.shape[1], cols):
            y = min(b.shape[1], x + cols)
            v, d, e, c = (z[:to - at, :y - x] for z in (xor, count, more, close))
            close[:to - at, y - x:] = False
            for w in range(WORDS - 1):
                np.bitwise_xor(a[w, at:to, None], b[w, None, x:y], out=v)
                np.bitwise_count(v, out=e if w else d)
                if w:
                    d += e
            np.less_equal(d, radius, out=c)
            some = np.flatnonzero(close[:to - at].reshape(-1).view(U64))
            if len(some):
                i, j = np.divmod((some[:, None] * 8 + np.arange(8)).ravel(), cols)
                i, j = (z[close[i, j]] for z in (i, j))
                far = d[i, j] + np.bitwise_count(a[-1, at + i] ^ b[-1, x + j])
                ok = far <= radius
                if same:
                    ok &= x + j > at + i
                if ok.any():
                    yield at + i[ok], x + j[ok], far[ok]


def _chunks(n_a: int, n_b: int, radius: int, pairs: float) -> list[tuple[int, int, int]]:
    """(first bit, bits, limit) of the chunks by which so many rows of random bits are compared soonest; limits of chunks: their
    sum is radius + 1 less the number of chunks. A single one if comparing all the pairs costs less."""
    best, cost = [(0, BITS, radius)], pairs
    for m in range(max(2, -(-BITS // 16)), min(radius + 1, 48) + 1):
        out, at = [], 0
        low, more = divmod(radius + 1 - m, m)
        for k in range(m):
            # The wider chunks have the larger limits.
            bits = BITS // m + (k < BITS % m)
            out.append((at, bits, low + (k < more)))
            at += bits
        hits = [(bits, sum(comb(bits, x) for x in range(most + 1))) for _, bits, most in out]
        c = sum(pairs * h / 2**bits + min(n_a, 2**bits) * CALL + n_b * h * GATHER * min(1, n_a / 2**bits) for bits, h in hits)
        if c < cost:
            best, cost = out, c
    return best


def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones."""
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= most]


def _bits_at(f: np.ndarray, at: int, bits: int) -> np.ndarray:
    """So many bits of each column, from bit at on."""
    w, k = divmod(at, 64)
    v = f[w] >> U64(k)
    if k + bits > 64:
        v = v | f[w + 1] << U64(64 - k)
    return (v & U64((1 << bits) - 1)).astype(np.int64)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["rep"].to_numpy(), np.stack([t[c].to_numpy().view(U64) for c in FINGER], 1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones do, at most one for each node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low), np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low), np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label != np.arange(len(ids)))
    return ids[k], ids[label[k]]


def _edges(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = _forest(*(np.concatenate(z) for z in list(zip(*pairs))[:2]))
    return np.minimum(a, b), np.maximum(a, b), np.zeros(len(a))


def _prints(text: str) -> Column:
    """The fingerprint of a text, and its number of words."""
    return F.arrow_udf(_fingerprint, "struct<f0: bigint, f1: bigint, f2: bigint, n: int>")(F.col(f"`{text}`").cast("string"))


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, f1, f2) of the documents that have an id and words."""
    t = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    return t.select("doc_id", _prints("text").alias("f")).select("doc_id", "f.*").where("n > 0").drop("n")


def close_pairs(prints: DataFrame, radius: int = RADIUS, forest: bool = False) -> DataFrame:
    """(a, b, distance, links) of all pairs of different rep within radius, a < b, of a table (rep, f0, f1, f2, copies) with a unique rep.

    Each fingerprint goes to its own leaf, and as a query to the leaves its ball overlaps that come after it, so that a pair
    is found once. Leaves are cut into blocks; every pair of blocks is a group of its own, so no group outgrows a task.
    forest: give only edges that connect the same groups, and rows (rep, rep) whose links are the copies of the fingerprints
    near it; each group of blocks gives its own share, to be summed.
    """
    spark = prints.sparkSession
    total = prints.count()
    rate = min(1.0, 1.3 * TREE_SAMPLE / max(total, 1))
    some = prints.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) <= int(rate * (1 << 30))).toArrow()
    _, f = _columns(some)
    share = total / max(1, len(f))
    tree = VpTree(f, max(64, int(BLOCK / max(share, 1e-9) / 2)), radius)
    sent = spark.sparkContext.broadcast(tree)
    kinds = "rep bigint, f0 bigint, f1 bigint, f2 bigint, copies bigint, leaf int, home boolean"

    def route(batches):
        tree = sent.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            _, f = _columns(t)
            row, leaf, home = tree.route(f)
            own = np.zeros(len(f), np.int64)
            own[row[home]] = leaf[home]
            go = leaf >= own[row]
            out = t.take(pa.array(row[go]))
            out = out.append_column("leaf", pa.array(leaf[go].astype(np.int32))).append_column("home", pa.array(home[go]))
            yield from out.to_batches()

    routed = cut(prints.select("rep", *FINGER, "copies").mapInArrow(route, kinds))
    size = {r.leaf: (r.h, r.q) for r in routed.groupBy("leaf").agg(F.sum(F.col("home").cast("int")).alias("h"), F.sum((~F.col("home")).cast("int")).alias("q")).collect()}
    cells = {k: (-(-h // BLOCK), -(-q // (2 * BLOCK))) for k, (h, q) in size.items() if h}
    if not cells:
        return spark.createDataFrame([], "a bigint, b bigint, distance double, links bigint")
    groups, first = 0, {}
    for k, (h, q) in cells.items():
        first[k] = groups
        groups += h * (h + 1) // 2 + h * q
    parts = min(PARTS, -(-SPREAD // groups))
    grid = spark.sparkContext.broadcast((cells, first, _apart(spark, groups * parts)))

    def spread(batches):
        cells, first, labels = grid.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            leaf, home = t["leaf"].to_numpy(), t["home"].to_numpy(zero_copy_only=False)
            key = mix(t["rep"].to_numpy().view(U64))
            hs, qs = (np.array([cells.get(x, (0, 0))[k] for x in leaf], np.int64) for k in (0, 1))
            own = (key % np.maximum(np.where(home, hs, qs), 1).astype(U64)).astype(np.int64)
            rows, gi, gj = [], [], []
            for r in range(int(hs.max(initial=0))):
                # A home row of block i is the side A of the cells (i, j <= i), the side B of (k > i, i), and side A for each block of queries.
                k = np.flatnonzero(home & (r < hs))
                rows.append(k), gi.append(np.maximum(own[k], r)), gj.append(np.minimum(own[k], r))
                k = np.flatnonzero(~home & (r < hs))
                rows.append(k), gi.append(np.full(len(k), r)), gj.append(-1 - own[k])
            for q in range(int(qs.max(initial=0))):
                k = np.flatnonzero(home & (q < qs))
                rows.append(k), gi.append(own[k]), gj.append(np.full(len(k), -1 - q))
            row = np.concatenate(rows) if rows else np.zeros(0, int)
            i, j = (np.concatenate(z) if rows else row for z in (gi, gj))
            # The cells of a leaf are numbered: pairs of its blocks, then blocks with blocks of queries.
            h, q, start = hs[row], qs[row], np.array([first.get(x, 0) for x in leaf], np.int64)[row]
            cell = start + np.where(j >= 0, i * (i + 1) // 2 + j, h * (h + 1) // 2 + i * q - 1 - j)
            for p in range(parts):
                out = t.take(pa.array(row))
                for name, x in (("block", own[row]), ("i", i), ("j", j), ("part", np.full(len(row), p))):
                    out = out.append_column(name, pa.array(x.astype(np.int32)))
                out = out.append_column("cell", pa.array(labels[cell * parts + p], pa.int64()))
                yield from out.to_batches()

    def compare(t: pa.Table) -> pa.Table:
        trim()
        rep, f = _columns(t)
        home, block, copies = t["home"].to_numpy(zero_copy_only=False), t["block"].to_numpy(), t["copies"].to_numpy()
        i, j, part = (t[x][0].as_py() for x in ("i", "j", "part"))
        A = np.flatnonzero(home & (block == i))
        B = np.flatnonzero(~home) if j < 0 else A if i == j else np.flatnonzero(home & (block == j))
        got, size, links = [], 0, np.zeros(len(rep), np.int64)
        for x, y, d in near(f[A], f[B], radius, i == j, part, parts):
            x, y = A[x], B[y]
            k = rep[x] != rep[y]
            x, y, d = x[k], y[k], d[k]
            a, b = rep[x], rep[y]
            got.append((np.minimum(a, b), np.maximum(a, b), d.astype(np.float64)))
            size += len(a)
            if forest:
                np.add.at(links, x, copies[y]), np.add.at(links, y, copies[x])
            if forest and size > 1 << 20:
                # Many copies of a text have far more pairs than are needed to connect them.
                got = [_edges(got)]
                size = 0
        if forest and got:
            got = [_edges(got)]
        k = np.flatnonzero(links)
        got.append((rep[k], rep[k], np.zeros(len(k))))
        a, b, d = (np.concatenate(z) for z in zip(*got))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.float64()), "links": pa.array(np.concatenate([np.zeros(len(a) - len(k), np.int64), links[k]]))})

    laid = routed.mapInArrow(spread, f"{kinds}, block int, i int, j int, part int, cell bigint")
    # By their number, not by their bytes: a pair of blocks is few bytes and much work.
    laid = laid.repartition(min(groups * parts, MANY), "cell")
    return laid.groupBy("cell").applyInArrow(compare, "a bigint, b bigint, distance double, links bigint")


def _apart(spark: SparkSession, n: int) -> np.ndarray:
    """n labels that a shuffle to n partitions puts in one each; beyond MANY just numbers, as chance spreads these well enough."""
    if n > MANY:
        return np.arange(n)
    found, most = {}, 8 * n + 64
    while len(found) < n:
        most *= 2
        x = spark.range(most).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
        found = {r["at"]: r["id"] for r in x.collect()}
    return np.array([found[k] for k in range(n)], np.int64)


def _nodes(docs: DataFrame, doc_id: str, text: str, radius: int) -> tuple[DataFrame, DataFrame, bool, DataFrame]:
    """The documents' fingerprints; the different ones with their number of documents and a unique rep, which is the smallest
    doc_id if no document has several; whether one has; and what close_pairs() gives."""
    prints = cut(fingerprint_table(docs, doc_id, text).distinct())
    same = cut(prints.groupBy(*FINGER).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    several = not same.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    if several:
        same = cut(same.withColumn("rep", F.monotonically_increasing_id()))
    return prints, same, several, cut(close_pairs(same, radius, forest=True))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, links, keep) of every document that has near-duplicates; group_id is the group's smallest doc_id,
    which is kept; links: other documents at most radius away, counted for each of a document's texts."""
    prints, same, several, found = _nodes(docs, doc_id, text, radius)
    edges = found.where("a <> b").select("a", "b")
    if several:
        # A document's texts are one node of the graph.
        member = prints.join(same, FINGER).select("doc_id", "rep")
        low = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count("*").alias("k")).where("k > 1").drop("k")
        edges = edges.union(member.join(low, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    groups = components(edges).select(F.col("id").alias("rep"), F.col("group").alias("g"))
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    info = same.join(groups, "rep", "left").join(links, "rep", "left").where("copies > 1 or g is not null")
    info = info.select(*FINGER, F.coalesce("g", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = prints.join(info, FINGER).select("doc_id", "group_id", "links")
    if several:
        out = out.groupBy("doc_id").agg(F.min("group_id").alias("g"), F.sum("links").alias("links"))
        first = out.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("k")).where("k > 1").drop("k")
        out = out.join(first, "g")
    return out.select("doc_id", "group_id", "links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those of which a near-duplicate that comes before (by doc_id, then fingerprint) stays; of rows
    with the same doc_id and words one stays.

    Rows without id or without words stay. The columns are those of docs.
    """
    key, count, finger = fresh(docs, "gone_id", "times", "finger")
    prints, same, several, found = _nodes(docs, doc_id, text, radius)
    groups = components(found.where("a <> b").select("a", "b"))
    info = same.join(groups.select(F.col("id").alias("rep"), F.col("group").alias("g")), "rep", "left").where("copies > 1 or g is not null").select(*FINGER, F.coalesce("g", "rep").alias("g"))
    member = prints.join(info, FINGER)
    first = member.groupBy("g").agg(F.min(F.struct("doc_id", *FINGER)).alias("first"))
    gone = member.join(first, "g").where(F.struct("doc_id", *FINGER) != F.col("first")).select(F.col("doc_id").alias(key), *FINGER)
    match = F.col(f"`{doc_id}`") == F.col(key)
    again = cut(docs.groupBy(F.col(f"`{doc_id}`").cast("bigint").alias(key)).agg(F.count("*").alias(count)).where(f"{count} > 1 and {key} is not null").select(key))
    if again.isEmpty():
        return docs.join(gone.select(key), match, "left_anti")
    # Where rows share a doc_id, each is told by its own text.
    once = docs.join(again, match, "left_anti").join(gone.select(key), match, "left_anti")
    more = docs.join(again, match, "left_semi").withColumn(finger, _prints(text))
    own = [F.col(f"`{finger}`.{c}") for c in FINGER]
    worded = F.col(f"`{finger}`.n") > 0
    left = more.where(worded).join(gone.select(key, F.struct(*FINGER).alias(count)), match & (F.struct(*own) == F.col(count)), "left_anti").dropDuplicates([doc_id, finger])
    return once.unionByName(left.drop(finger)).unionByName(more.where(~worded | worded.isNull()).drop(finger))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
ORACLES: dict[str, str] = {}

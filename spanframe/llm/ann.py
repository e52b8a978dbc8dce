"""Approximate nearest neighbours of every vector by multiprobe p-stable hashing.

A table hashes a vector by PROJECTIONS random projections (Gaussian, so 2-stable), each cut into cells of width 2 r, where r
is the distance at which neighbours are expected. Given where a query is in its cells, the chance that a neighbour at
distance r falls into the cell before or after is known in each projection; the chance of a perturbed bucket is their
product. A query visits buckets in the order of that chance until its sum reaches what each table has to find for the
target over all tables. A query for which PROBES buckets a table don't reach it is compared with all vectors instead.
Candidates of a bucket are compared by exact distance; the best of all tables are merged.

Buckets are dealt to shards by their keys. A vector crosses the network once a table, a query once for each shard in which
it visits buckets. In a shard its vectors come first and are held, then the queries stream by, so a shard's memory is that
of its vectors alone; a shard of more than twice SHARD vectors, as equal ones make it, is cut by a salt of their ids, and what asks
it asks all its parts. No vector is sent twice for the number of queries, and no group grows with the input.

r comes from a bounded sample (SAMPLE vectors) and is the 95th percentile, over queries in it, of the distance to as many
neighbours as the sample should have; a sample too small to have one makes r larger, so more buckets are visited, never fewer.

Defined results: a row without id, without vector, of a length other than the most frequent one, or with a value that is
null, NaN or infinite takes no part; rows with the query's own id aren't its neighbours; repeated rows are one; equal
distances are ordered by id, and so are equal vectors where only some fit (different vectors whose distances differ by no more
than the rounding of 32 bits may take each other's place as the last of the k); an id with several vectors asks with the smallest; a query of which fewer than k candidates are found has fewer rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import U64, cut, mix, trim

K = 10
TABLES = 2
TARGET = 0.965
SAMPLE = 4096
#: Perturbations that are weighed for a query, at most; they are those of the best expected chance. Where they are too few, all buckets are visited.
PROBES = 4096
#: Vectors of a table that one shard is meant to hold, shards of a table at least, and queries that a shard compares at once.
SHARD, SHARDS, AT_ONCE = 1 << 16, 4, 1024
#: Every so manieth id asks in the registered query.
EVERY = 50
#: Vectors in a bucket, about, if a projection's two commonest cells held them all.
BUCKET = 1024


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function; Abramowitz and Stegun 7.1.26, exact to 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * e)


def templates(m: int, limit: int) -> np.ndarray:
    """(sets x 2m) perturbation sets in the order of their expected cost, over the 2m cell borders from the nearest to the farthest.
    The k-th nearest and the k-th farthest are the two borders of one cell, so a set has at most one of them."""
    cost = np.array([k * (k + 1) / (4 * (m + 1) * (m + 2)) for k in range(1, m + 1)] + [1 - (2 * m + 1 - k) / (m + 1) + (2 * m + 1 - k) * (2 * m + 2 - k) / (4 * (m + 1) * (m + 2)) for k in range(m + 1, 2 * m + 1)])
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < limit:
        c, s = heapq.heappop(heap)
        if all(2 * m - 1 - k not in s for k in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    x = np.zeros((len(out), 2 * m), np.float32)
    for i, s in enumerate(out):
        x[i, list(s)] = 1
    return x


class Hash:
    """The tables' projections, and which buckets a query visits."""

    def __init__(self, sample: np.ndarray, total: int, k: int, tables: int, target: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim, self.tables = sample.shape[1], tables
        some = sample[:512]
        d = np.sort(np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * some @ sample.T)), 1)
        nth = min(d.shape[1] - 1, max(1, math.ceil(k * len(sample) / max(total, 1))))
        spread = float(np.median(d[:, -1])) if len(d) else 1.0
        self.r = max(float(np.quantile(d[:, nth], 0.95)), spread * 1e-3, 1e-12)
        self.m = int(min(16, max(2, round(math.log2(max(total, 2) / BUCKET)))))
        self.width = 2 * self.r
        self.a = rng.standard_normal((tables, self.dim, self.m)).astype(np.float64)
        self.b = rng.random((tables, self.m)) * self.width
        self.each = 1 - (1 - target) ** (1 / tables)
        self.sets = templates(self.m, PROBES)

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and positions in the cells."""
        p = (x.astype(np.float64) @ self.a[t] + self.b[t]) / self.width
        c = np.floor(p)
        return c.astype(np.int64), (p - c) * self.width

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        h = np.zeros(cells.shape[:-1], U64)
        for j in range(cells.shape[-1]):
            h = mix(h * U64(31) + cells[..., j].astype(U64))
        return h

    def borders(self, x: np.ndarray, t: int):
        """Cells, the chance of staying in each, the projections by their nearest border, which side that is on, and the
        log odds of crossing the borders: those of the nearest in that order, then the cells' other borders in reverse."""
        c, u = self.cells(x, t)
        r, w = self.r, self.width
        here = np.maximum(_phi((w - u) / r) - _phi(-u / r), 1e-12)
        before = np.maximum(_phi(-u / r) - _phi((-w - u) / r), 1e-12)
        after = np.maximum(_phi((2 * w - u) / r) - _phi((w - u) / r), 1e-12)
        near = np.where(u < w - u, -1, 1)
        order = np.argsort(np.minimum(u, w - u), 1, kind="stable")
        row = np.arange(len(x))[:, None]
        low, high = np.where(near < 0, before, after), np.where(near < 0, after, before)
        odds = np.concatenate([np.log(low / here)[row, order], np.log(high / here)[row, order][:, ::-1]], 1)
        return c, here, order, near[row, order], odds

    def probes(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, perturbation set) of the buckets that each query visits in table t, in the order of their chance."""
        return self.weighed(x, t)[:2]

    def weighed(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What probes() gives, and the summed chance of each query's buckets."""
        _, here, _, _, odds = self.borders(x, t)
        score = np.exp(odds.astype(np.float32) @ self.sets.T + np.log(here).sum(1, keepdims=True).astype(np.float32))
        best = np.argsort(-score, 1, kind="stable")
        got = np.cumsum(np.take_along_axis(score, best, 1), 1)
        q, at = np.nonzero(np.concatenate([np.ones((len(x), 1), bool), got[:, :-1] < self.each], 1))
        return q, best[q, at], got[np.arange(len(x)), np.bincount(q, minlength=len(x)) - 1]

    def plan(self, x: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """probes() of each table, and which queries they don't suffice for: these visit nothing there and are to be compared with all."""
        found = [self.weighed(x, t) for t in range(self.tables)]
        lost = np.prod([1 - np.minimum(got.astype(np.float64), 1) for _, _, got in found], 0)
        whole = lost > (1 - self.each) ** self.tables + 1e-5
        return [(q[~whole[q]], sets[~whole[q]]) for q, sets, _ in found], whole

    def visited(self, x: np.ndarray, t: int, q: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """The keys of the buckets that perturbation sets lead to."""
        c, _, order, near, _ = self.borders(x, t)
        m = self.m
        step = np.concatenate([near, -near[:, ::-1]], 1).astype(np.int8)
        keys = np.empty(len(q), U64)
        for s in range(0, len(q), 1 << 18):
            e = slice(s, s + (1 << 18))
            move = self.sets[sets[e]].astype(np.int8) * step[q[e]]
            move = move[:, :m] + move[:, :m - 1:-1]  # in the order of the nearest borders
            cell = c[q[e]].copy()
            cell[np.arange(len(cell))[:, None], order[q[e]]] += move
            keys[e] = self.keys(cell)
        return keys


class Shard:
    """Vectors by bucket, to be asked by one batch of queries after another. Equal vectors are compared once; of their ids
    the k + 1 smallest can be among the k nearest of a query that has one of them."""

    def __init__(self, bucket: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.k = k
        rows = np.ascontiguousarray(x + np.float32(0)).view(f"V{4 * x.shape[1]}").ravel()
        _, vector = np.unique(rows, return_inverse=True)
        order = np.lexsort((ids, vector, bucket))
        bucket, vector, ids = bucket[order], vector[order], ids[order]
        head = np.concatenate([[True], (vector[1:] != vector[:-1]) | (bucket[1:] != bucket[:-1])])
        place = np.arange(len(ids)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        few = place <= k
        self.ids, edge = ids[few], np.flatnonzero(head[few])
        self.first, self.many = edge, np.diff(np.append(edge, len(self.ids)))
        bucket, self.x = bucket[head], x[order[head]]
        #: The id of a vector that has one, to leave out queries themselves.
        self.only, self.alone = self.ids[edge], self.many == 1
        self.own, self.start = np.unique(bucket, return_index=True)
        self.stop = np.append(self.start[1:], len(bucket))
        self.size = (self.x.astype(np.float64) ** 2).sum(1).astype(np.float32)

    def ask(self, qid: np.ndarray, q: np.ndarray, visit: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour id, distance) of the best k for each query among the vectors of the buckets `keys` that it visits."""
        at = np.searchsorted(self.own, keys)
        ok = (at < len(self.own)) & (self.own[np.minimum(at, len(self.own) - 1)] == keys)
        at, visit = at[ok], visit[ok]
        by = np.argsort(at, kind="stable")
        at, visit = at[by], visit[by]
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, int)
        return self._best(qid, q, [(self.start[at[a]], self.stop[at[a]], visit[a:b]) for a, b in zip(edge[:-1], edge[1:])])

    def ask_all(self, qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ask(), of all vectors."""
        return self._best(qid, q, [(0, len(self.x), np.arange(len(q)))])

    def _best(self, qid: np.ndarray, q: np.ndarray, runs: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.k
        best = np.full((len(q), k), np.inf, np.float32)
        who = np.full((len(q), k), -1, np.int64)
        qsize = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)
        for first, last, asked in runs:
            for s in range(first, last, 1024):
                e = min(s + 1024, last)
                for f in range(0, len(asked), 4096):
                    v = asked[f:f + 4096]
                    d = qsize[v][:, None] + self.size[s:e] - 2 * (q[v] @ self.x[s:e].T)
                    d[self.alone[s:e] & (qid[v][:, None] == self.only[s:e])] = np.inf
                    both = np.concatenate([best[v], d], 1)
                    top = np.argpartition(both, k - 1, 1)[:, :k]
                    best[v] = np.take_along_axis(both, top, 1)
                    who[v] = np.where(top < k, np.take_along_axis(who[v], np.minimum(top, k - 1), 1), s + np.clip(top - k, 0, e - s - 1))
        i, j = np.nonzero(np.isfinite(best))
        n = who[i, j]
        exact = np.empty(len(n))
        for s in range(0, len(n), 1 << 16):
            e = slice(s, s + (1 << 16))
            exact[e] = np.sqrt(((q[i[e]].astype(np.float64) - self.x[n[e]]) ** 2).sum(1))
        many = self.many[n]
        before = np.cumsum(many) - many
        ids = self.ids[np.arange(many.sum()) + np.repeat(self.first[n] - before, many)]
        i, exact = np.repeat(i, many), np.repeat(exact, many)
        ok = ids != qid[i]
        i, exact, ids = i[ok], exact[ok], ids[ok]
        by = np.lexsort((ids, exact, i))
        i, exact, ids = i[by], exact[by], ids[by]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[ok], ids[ok], exact[ok]


def _clean(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    base = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return base.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def nearest(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", queries: DataFrame | None = None, tables: int = TABLES, target: float = TARGET, seed: int = 0) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest rows of vectors for every row of queries (none: of vectors), as far as the buckets hold them."""
    spark = vectors.sparkSession
    base = _clean(vectors, vec_id, embedding)
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, distance double")
    base, total, dim = base.where(F.size("v") == sizes.dim), sizes.n, sizes.dim
    asking = base if queries is None else _clean(queries, vec_id, embedding).where(F.size("v") == dim)
    rate = min(1.0, SAMPLE / total)
    some = base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) <= int(rate * (1 << 30))).select("v").toArrow()["v"].combine_chunks()
    sample = some.flatten().to_numpy().reshape(-1, dim)
    if not len(sample):
        sample = np.array([r.v for r in base.select("v").limit(SAMPLE).collect()], np.float32)
    made = Hash(sample[np.random.default_rng(seed).permutation(len(sample))], total, k, tables, target, seed)
    sent = spark.sparkContext.broadcast(made)
    shards = max(SHARDS, -(-total // SHARD))

    def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, dim)

    def raw(x: np.ndarray) -> pa.Array:
        step = dim * 4
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * step, step, dtype=np.int32)[:len(x) + 1]), pa.py_buffer(np.ascontiguousarray(x, np.float32))])

    def whole_numbers(n: int, value) -> pa.Array:
        return pa.array(np.full(n, value, np.int32) if np.isscalar(value) else value.astype(np.int32))

    def row_batch(t, shard, kind: int, ids: np.ndarray, key: pa.Array, sets: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([whole_numbers(n, t), whole_numbers(n, shard), whole_numbers(n, kind), pa.array(ids), key, sets, raw(x)], ["t", "shard", "kind", "id", "key", "sets", "v"])

    def no_sets(n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int16()))

    def place(batches):
        h = sent.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                ids, x = vectors_of(batch.slice(at, 2048))
                for t in range(h.tables):
                    key = h.keys(h.cells(x, t)[0])
                    yield row_batch(t, key % U64(shards), 0, ids, pa.array(key.view(np.int64)), no_sets(len(x)), x)

    def tally(batches):
        h = sent.value
        for batch in batches:
            _, x = vectors_of(batch)
            for t in range(h.tables):
                shard, n = np.unique(h.keys(h.cells(x, t)[0]) % U64(shards), return_counts=True)
                yield pa.RecordBatch.from_arrays([whole_numbers(len(n), t), whole_numbers(len(n), shard), pa.array(n.astype(np.int64))], ["t", "shard", "n"])

    def ask(batches):
        h = sent.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                ids, x = vectors_of(batch.slice(at, 512))
                plan, whole = h.plan(x)
                whole = np.flatnonzero(whole)
                for s in range(shards if len(whole) else 0):
                    # Each vector is once in the first table; no perturbation set stands for all of a shard.
                    yield row_batch(0, s, 1, ids[whole], pa.nulls(len(whole), pa.int64()), no_sets(len(whole)), x[whole])
                for t, (q, sets) in enumerate(plan):
                    if not len(q):
                        continue
                    shard = (h.visited(x, t, q, sets) % U64(shards)).astype(np.int64)
                    by = np.lexsort((shard, q))
                    q, sets, shard = q[by], sets[by].astype(np.int16), shard[by]
                    edge = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (shard[1:] != shard[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(q)), pa.int32()), pa.array(sets))
                    own = q[edge]
                    yield row_batch(t, shard[edge], 1, ids[own], pa.nulls(len(own), pa.int64()), lists, x[own])
            trim()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held, shard = sent.value, [], None
        matrix = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(-1, dim)
        for batch in batches:
            kind = batch["kind"].to_numpy()
            n = int(np.count_nonzero(kind == 0))
            if n:
                if shard is not None or kind[:n].any():
                    raise RuntimeError("vectors after queries: the shard isn't sorted")
                part = batch.slice(0, n)
                held.append((part["key"].to_numpy().view(U64), part["id"].to_numpy(), matrix(part["v"])))
            if not held or n == len(batch):
                continue
            if shard is None:
                shard, held = Shard(*(np.concatenate(z) for z in zip(*held)), k), [(0, 0, 0)]
            for at in range(n, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                sets, qid, q = part["sets"], part["id"].to_numpy(), matrix(part["v"])
                many = sets.value_lengths().to_numpy()
                visit = np.repeat(np.arange(len(part)), many)
                got = [shard.ask(qid, q, visit, h.visited(q, part["t"][0].as_py(), visit, sets.flatten().to_numpy()))]
                whole = np.flatnonzero(many == 0)
                if len(whole):
                    i, n_, d = shard.ask_all(qid[whole], q[whole])
                    got.append((whole[i], n_, d))
                i, n_, d = (np.concatenate(z) for z in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(d), pa.array(n_)], ["id", "d", "n"])
        del held, shard
        trim()

    kinds = "t int, shard int, kind int, id bigint, key bigint, sets array<smallint>, v binary"
    # Rows that repeat are one before they can make a shard hot.
    placed = base.dropDuplicates(["id", "v"]).mapInArrow(place, kinds)
    asked = asking.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(ask, kinds)
    # A row for each shard of too many vectors: at most tables * total / (2 * SHARD), and mostly none.
    hot = cut(base.select("id", "v").mapInArrow(tally, "t int, shard int, n bigint").groupBy("t", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * SHARD).select("t", "shard", F.ceil(F.col("n") / SHARD).cast("int").alias("parts")))
    if hot.isEmpty():
        both = placed.union(asked).withColumn("salt", F.lit(0))
    else:
        placed = placed.join(hot, ["t", "shard"], "left").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")).drop("parts")
        asked = asked.join(hot, ["t", "shard"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        both = placed.unionByName(asked)
    group = ["t", "shard", "salt"]
    # The sort by kind within a group is kept, as it begins with what the grouping needs sorted.
    laid = both.repartition(min(tables * shards, 1 << 16), *group).sortWithinPartitions(*group, "kind")
    found = laid.groupBy(*group).applyInArrow(answer, "id bigint, d double, n bigint")
    # An id comes at most once from each table, so the best k are among the first k * tables.
    best = found.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("d", "n"))).where(F.col("i") <= k * tables)
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("c"))
    first = F.filter("c", lambda x, i: ~F.exists(F.slice("c", 1, i), lambda y: y["n"] == x["n"]))
    return best.select("id", F.posexplode(F.slice(first, 1, k)).alias("i", "c")).select(F.col("id").alias("vec_id"), (F.col("i") + 1).alias("rank"), F.col("c.n").alias("neighbor_id"), F.col("c.d").alias("distance"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id EVERY divides, among all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, queries=vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op3_ann": op3_ann}
ORACLES: dict[str, str] = {}

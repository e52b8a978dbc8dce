"""Passages of MIN_WORDS words or more that several documents share, by prefix-partitioned suffix trees.

A suffix begins at a word. Of all suffixes those are indexed that winnowing chooses: the smallest hash of PREFIX words in
every stretch of MIN_WORDS words, so that equal stretches choose equal places, and a repeated stretch of MIN_WORDS words
always holds a suffix that is indexed wherever it occurs. Suffixes are partitioned by their prefixes. A prefix that comes
once can't begin a repeat and is dropped before any text moves; small ones are packed into groups that fit a task; one
with more than GROUP suffixes is split by longer prefixes. As what a suffix shares to its left also counts, each split at
depth d makes two kinds of groups: suffixes with the same d words, and those with the same words to the left that a
repeat of fewer than d words to the right would need. In a group the suffixes are sorted, which with the lengths of their
common prefixes is the suffix tree: its nodes of depth d are the runs of suffixes that share d words. Those that with the words
shared to the left are deep enough are its deep internal nodes, the repeats; how far a suffix goes in them to both sides is the
maximal repeat at that place. No node is followed more than MIN_WORDS words to a side, as a longer repeat is a chain of
overlapping ones. A document's repeats that touch or overlap are joined to a passage. It carries the number of documents that
its most frequent MIN_WORDS words are in, and for each suffix the id of its node with the most documents, which the node's
words alone decide: passages of one id share MIN_WORDS words. (All nodes' ids would be some 20 a suffix among near copies.)

Words are runs without ASCII white space and are compared by 64 (prefix) and 32 bits (the rest) of their hashes.

Defined results: null, empty and shorter texts have no repeats; rows with the same doc_id and text are one document, so
they don't repeat each other; a repeat within one document alone is reported if `within` is set; a text of any length is read
whole. Rows without doc_id are left out, other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import U64, discard, mix, scratch, text_bytes, text_chunks, trim, words

MIN_WORDS = 50
PREFIX = 8
#: Suffixes that a group is meant to hold; each takes some 400 bytes.
GROUP = 60_000
_DEEPER = (16, 32)


def _sliding(a: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each window of w values; len(a) - w + 1 of them. In blocks, each value is touched three times whatever w is."""
    n = len(a)
    if n < w:
        return a[:0]
    fill = np.full(-n % w, a[-1], a.dtype)
    blocks = np.concatenate([a, fill]).reshape(-1, w)
    left = f.accumulate(blocks, 1).ravel()[:n]
    right = f.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return f(right[:n - w + 1], left[w - 1:])


def anchors(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, prefix hash) of the suffixes that winnowing chooses."""
    out = []
    for first, part in text_chunks(texts):
        data, offs = text_bytes(part)
        _, _, row, h = words(data, offs)
        n = len(h)
        if n < min_words:
            continue
        begin = np.searchsorted(row, np.arange(len(part)))
        w = min_words - PREFIX + 1
        gram = h[:n - PREFIX + 1].copy()
        for k in range(1, PREFIX):
            gram = mix(gram * U64(3) + h[k:n - PREFIX + 1 + k])
        gram |= U64(1)
        low = _sliding(gram, w, np.minimum)
        low[row[:len(low)] != row[min_words - 1:][:len(low)]] = 0
        # Chosen: the smallest of at least one whole window, each window being one of the w that end here or later.
        pad = np.zeros(w - 1, U64)
        best = _sliding(np.concatenate([pad, low, pad]), w, np.maximum)
        at = np.flatnonzero(best == gram)
        out.append((row[at] + first, at - begin[row[at]], gram[at]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out))


def contexts(text: str, at: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix at word number `at`: 32-bit words to its right, words to its left from the nearest, and how many of them there are."""
    data, offs = text_bytes(pa.array([text]))
    h = (words(data, offs)[3] >> U64(32)).astype(np.uint32)
    n, far = len(h), min_words - PREFIX
    padded = np.concatenate([np.zeros(far, np.uint32), h, np.zeros(min_words, np.uint32)])
    right = padded[far + at[:, None] + np.arange(min_words)]
    left = padded[far + at[:, None] - 1 - np.arange(far)]
    return right, left, np.minimum(n - at, min_words), np.minimum(at, far)


def repeats(prefix: np.ndarray, doc: np.ndarray, right: np.ndarray, left: np.ndarray, rights: np.ndarray, lefts: np.ndarray, min_words: int = MIN_WORDS, within: bool = False) -> tuple[np.ndarray, ...]:
    """(suffix, words to its left, words to its right, documents, id) of the suffixes in a repeat of min_words words: how far it
    goes to both sides, and how many documents are in its most frequent node, which one being the id."""
    n = len(prefix)
    # The suffix tree of each prefix: suffixes in order, and how many words each shares with the one before.
    rows = np.ascontiguousarray(np.concatenate([prefix.astype(">u8").view(np.uint8).reshape(n, 8), right.astype(">u4").view(np.uint8).reshape(n, -1)], 1))
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    r, size, p = right[order], rights[order], prefix[order]
    shared = np.zeros(n, np.int64)
    if n > 1:
        same = r[1:] == r[:-1]
        depth = np.where(same.all(1), r.shape[1], same.argmin(1))
        shared[1:] = np.where(p[1:] == p[:-1], np.minimum(depth, np.minimum(size[1:], size[:-1])), 0)
    # hash of the nearest k words to the left, for each k
    near = np.zeros((n, left.shape[1] + 1), U64)
    for k in range(left.shape[1]):
        near[:, k + 1] = mix(near[:, k] * U64(3) + left[order, k] + U64(1))
    d, has, far = doc[order], lefts[order], p.copy()
    lo, hi, docs, name = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, U64)
    for depth in range(PREFIX, min_words + 1):
        if depth > PREFIX:
            far = mix(far * U64(3) + r[:, depth - 1] + U64(1))
        node = np.cumsum(shared < depth)
        need = min_words - depth
        live = np.flatnonzero((size >= depth) & (has >= need))
        if len(live) < 2:
            continue
        key = mix(near[live, need] ^ (node[live].astype(U64) * U64(0x9E3779B97F4A7C15)))
        by = np.lexsort((d[live], key))
        k, dd = key[by], d[live][by]
        split = np.concatenate([[True], k[1:] != k[:-1]])
        edge = np.append(np.flatnonzero(split), len(k))
        count = np.add.reduceat(split | np.concatenate([[True], dd[1:] != dd[:-1]]), edge[:-1], dtype=np.int64)
        many = (np.diff(edge) if within else count) > 1
        hit, count = live[by[np.repeat(many, np.diff(edge))]], np.repeat(count[many], np.diff(edge)[many])
        lo[hit] = np.maximum(lo[hit], need)
        hi[hit] = depth
        more = count > docs[hit]
        best = hit[more]
        docs[best] = count[more]
        name[best] = mix(far[best] ^ (near[best, need] * U64(0x9E3779B97F4A7C15) + U64(depth)))
    k = np.flatnonzero(hi)
    return order[k], lo[k], hi[k], docs[k], name[k]


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, group: int = GROUP, within: bool = False) -> DataFrame:
    """(doc_id, start_char, end_char, start_word, n_words, n_docs, repeats) of each document's passages that other documents share.

    n_docs: documents that the passage's most frequent stretch of min_words words is in; repeats: the ids of its most frequent repeats.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    base = base.withColumn("key", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, h = anchors(batch.column(1), min_words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "at", "prefix"])
            del batch
            trim()

    # Written, as it is read twice: once counted by prefix, which combines before it moves, and once joined with the counts.
    at = scratch(spark, "shared-passages")
    base.select("key", "text").mapInArrow(find, "key bigint, at int, prefix bigint").write.parquet(f"{at}/anchors")
    found = spark.read.parquet(f"{at}/anchors")
    counts = found.groupBy("prefix").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    counts = counts.where("n > 1" if within else "low < high").select("prefix", F.least("n", F.lit(1 << 30)).cast("int").alias("n"))
    again = found.join(counts, "prefix").groupBy("key").agg(F.collect_set(F.struct("at", "prefix", "n")).alias("found"))
    # The texts that share a prefix are written once and read for their contexts, and again for the places of the results. Texts
    # cross the network once and aren't sorted; rows that repeat are one after the join, which has brought them together.
    base.join(again.hint("shuffle_hash"), "key").dropDuplicates(["key"]).write.parquet(f"{at}/texts")
    hits = spark.read.parquet(f"{at}/texts")
    discard(spark, f"{at}/anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                s = batch.column(2)[i].values
                where, prefix, n = (s.field(k).to_numpy() for k in range(3))
                right, left, rights, lefts = contexts(t, where.astype(np.int64), min_words)
                groups = [prefix]
                rows = [np.arange(len(where))]
                big = np.flatnonzero(n > group)
                if len(big):
                    groups[0] = prefix.copy()
                    parts = _split(prefix[big].view(U64), right[big], left[big], rights[big], lefts[big], min_words)
                    keep = np.flatnonzero(n <= group)
                    groups, rows = [prefix[keep]], [keep]
                    for own, g in parts:
                        groups.append(g.view(np.int64)), rows.append(big[own])
                g, r = np.concatenate(groups), np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(g), pa.array(np.full(len(r), key)), pa.array(where[r]), pa.array(rights[r].astype(np.int32)), pa.array(lefts[r].astype(np.int32)),
                    _binary(right[r]), _binary(left[r]),
                ], ["prefix", "key", "at", "rights", "lefts", "right", "left"])

    wide = hits.select("key", "text", "found").mapInArrow(extend, "prefix bigint, key bigint, at int, rights int, lefts int, right binary, left binary")
    total = hits.agg(F.sum(F.size("found"))).first()[0] or 0
    groups = max(1, -(-total // group))

    def tree(t: pa.Table) -> pa.Table:
        n = len(t)
        right = np.frombuffer(b"".join(t["right"].to_pylist()), np.uint32).reshape(n, -1)
        left = np.frombuffer(b"".join(t["left"].to_pylist()), np.uint32).reshape(n, -1)
        k, lo, hi, many, name = repeats(t["prefix"].to_numpy().view(U64), t["key"].to_numpy(), right, left, t["rights"].to_numpy(), t["lefts"].to_numpy(), min_words, within)
        at = t["at"].to_numpy()[k]
        out = pa.table({"key": t["key"].take(pa.array(k)), "a": pa.array((at - lo).astype(np.int32)), "b": pa.array((at + hi).astype(np.int32)), "name": pa.array(name.view(np.int64)), "docs": pa.array(many)})
        del t, right, left
        trim()
        return out

    # As many partitions as groups: none grows with the input.
    laid = wide.withColumn("g", F.pmod(F.xxhash64("prefix"), F.lit(groups))).repartition(min(groups, 1 << 17), "g")
    spans = laid.groupBy("g").applyInArrow(tree, "key bigint, a int, b int, name bigint, docs bigint")
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b", "name", "docs"))).alias("spans"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                t = batch.column(1)[i].as_py()
                s = batch.column(2)[i].values
                a, b, name, shared = s.field(0).to_numpy(), np.maximum.accumulate(s.field(1).to_numpy()), s.field(2).to_numpy(), s.field(3).to_numpy()
                head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                tail = np.append(head[1:], len(b))
                a, b = a[head], b[tail - 1]
                data, offs = text_bytes(pa.array([t]))
                start, end, _, _ = words(data, offs)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                d = batch.column(0)[i].as_py()
                rows += [(d, int(x), int(y), int(p), int(q - p), int(shared[u:v].max()), np.unique(name[u:v]).tolist()) for x, y, p, q, u, v in zip(chars[start[a]], chars[end[b - 1]], a, b, head, tail)]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64())))], ["doc_id", "start_char", "end_char", "start_word", "n_words", "n_docs", "repeats"])

    return hits.select("key", "doc_id", "text").join(spans, "key").select("doc_id", "text", "spans").mapInArrow(place, "doc_id bigint, start_char int, end_char int, start_word int, n_words int, n_docs bigint, repeats array<bigint>")


def _binary(a: np.ndarray) -> pa.Array:
    n, size = len(a), a.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32) if n else np.zeros(1, np.int32)), pa.py_buffer(np.ascontiguousarray(a, np.uint32))])


def _split(prefix: np.ndarray, right: np.ndarray, left: np.ndarray, rights: np.ndarray, lefts: np.ndarray, min_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of the suffixes of prefixes that have too many: (which suffixes, the hash of their group), so that any two
    that share enough words are in one group together."""
    out, own, h, depth = [], np.arange(len(prefix)), prefix, PREFIX
    for to in (*[d for d in _DEEPER if d < min_words], min_words):
        # Pairs that part after fewer than `to` words need the rest to their left.
        need = min_words - to + 1
        side = mix(h + U64(to))
        for k in range(need):
            side = mix(side * U64(3) + left[own, k] + U64(1))
        fits = lefts[own] >= need
        out.append((own[fits], side[fits]))
        for k in range(depth, to):
            h = mix(h * U64(3) + right[own, k] + U64(1))
        fits = rights[own] >= to
        own, h, depth = own[fits], h[fits], to
    out.append((own, mix(h + U64(1))))
    return out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES: dict[str, str] = {}

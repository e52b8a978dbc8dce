"""Byte-level BPE encoding and decoding of a corpus, each distinct word encoded once.

A block is the documents of one task. Its pre-tokens are numbered by frequency; the numbers, in the order of their
positions, are the block's payload, and its distinct words go, packed by the bucket of their hash, into the global
word shuffle. There all blocks' words of a bucket meet, each distinct one is encoded once, and the ids go back, packed
again, to their blocks in a second shuffle, where they are joined with the positions. So a text crosses the network as
one number a pre-token, and a word, however frequent, as one entry a block: no key is hot.

Defined results: a null text has null ids and decodes to null; an empty one has no ids and decodes to ""; repeated rows
are each encoded; other columns, whatever their names, are carried along if asked for. The input must give the same rows in the
same order when a task runs again, as files and checkpoints do: an executor's loss can make a block's two shuffles come from two
runs. Where they differ the job ends with an error and no wrong rows; write such an input first, as the pipeline's stages are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.bpe import Vocabulary, default_vocabulary, pretoken_starts
from spanframe.llm.common import U64, fresh, mix, powers, text_bytes, text_chunks, trim

#: Bytes of text a bucket of the word shuffle stands for. More buckets come with more text, so none outgrows a task.
BUCKET_BYTES = 8 << 20
#: Bytes of text after which a task begins another block.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose words a block numbers at once.
NUMBER_BYTES = 4 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers by byte planes, so that the planes that hold little compress to little."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u4")
        raw = zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
        out += [len(a).to_bytes(8, "little"), len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def _unpack(data: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    """n arrays, and what comes after them."""
    at, out = 0, []
    for _ in range(n):
        k, size = int.from_bytes(data[at:at + 8], "little"), int.from_bytes(data[at + 8:at + 16], "little")
        raw = np.frombuffer(zstandard.decompress(data[at + 16:at + 16 + size]), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(4, k).T).view("<u4").ravel())
        at += 16 + size
    return out, data[at:]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _distinct(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """For each word its place in the second array: the different words in the order they come."""
    made = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    return made.indices.to_numpy(), made.dictionary


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes, whatever else is in the array."""
    out = [np.zeros(0, U64)]
    for _, part in text_chunks(words):
        data, offs = text_bytes(part)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=total[1:])
        out.append(mix((total[offs[1:]] - total[offs[:-1]]) * down[offs[:-1]]))
    return np.concatenate(out)


class _Block:
    """Documents whose words are numbered together."""

    def __init__(self):
        self.words, self.flow, self.sizes, self.rows, self.bytes = [], [], [], [], 0
        self.digest = xxhash.xxh64()

    def add(self, rows: pa.RecordBatch, texts: pa.Array) -> None:
        self.rows.append(rows)
        words, held = [], 0
        for _, part in text_chunks(texts):
            data, offs = text_bytes(part)
            starts = pretoken_starts(data, offs)
            none = part.is_null().to_numpy(zero_copy_only=False)
            size = np.diff(np.searchsorted(starts, offs)).astype(np.uint32)
            size[none] = 0xFFFFFFFF
            self.sizes.append(size)
            for x in (none, np.diff(offs), data):
                self.digest.update(np.ascontiguousarray(x))
            self.bytes += len(data)
            words.append(_binary(data, np.append(starts, len(data))))
            held += len(data)
            if held >= NUMBER_BYTES:
                self._number(words)
                words, held = [], 0
        self._number(words)

    def _number(self, words: list[pa.Array]) -> None:
        """Keep the different words, and the places in them of all."""
        own, distinct = _distinct(words)
        self.flow.append(own), self.words.append(distinct)

    def pieces(self, task: int, k: int, buckets: int):
        """(key, block, bucket, data): the payload with bucket -1, and the packed words of each bucket."""
        self.digest.update(task.to_bytes(8, "little") + k.to_bytes(8, "little"))
        block = int.from_bytes(self.digest.digest(), "little", signed=True)
        number, distinct = _distinct(self.words)
        number = np.split(number, np.cumsum([len(w) for w in self.words])[:-1])
        n, flow = len(distinct), np.concatenate([x[own] for x, own in zip(number, self.flow)])
        self.words, self.flow = [], []
        order = np.argsort(-np.bincount(flow, minlength=n), kind="stable")
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        bucket = (_hashes(distinct)[order] % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        data, offs = text_bytes(distinct.take(pa.array(order[by])))
        sizes = np.diff(offs)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(self.rows)
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        meta = zstandard.compress(sink.getvalue().to_pybytes(), 1)
        yield block % buckets, block, -1, _pack(rank[flow], np.concatenate([np.zeros(0, np.uint32), *self.sizes]), np.array([len(cuts)], np.uint32)) + meta
        for a, b in zip(cuts, np.append(cuts[1:], n)):
            own = by[a:b]
            raw = zstandard.compress(data[offs[a]:offs[b]].tobytes(), 1)
            yield int(bucket[own[0]]), block, int(bucket[own[0]]), _pack(np.diff(own, prepend=0), sizes[a:b]) + raw


def _encode_bucket(vocabulary: Vocabulary, rows: list[tuple[int, bytes]]):
    """(block, packed ids) of the blocks' words of one bucket; a word is encoded once however many blocks have it."""
    gaps, words = [], []
    for _, data in rows:
        (g, sizes), raw = _unpack(data, 2)
        gaps.append(g)
        words.append(_binary(np.frombuffer(zstandard.decompress(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])))
    own, distinct = _distinct(words)
    own = np.split(own, np.cumsum([len(w) for w in words])[:-1])
    ids, at = vocabulary.encode(*text_bytes(distinct))
    for (block, _), g, k in zip(rows, gaps, own):
        size = at[k + 1] - at[k]
        yield block, _pack(g, size, _ragged(ids, at[k], size))


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size] one after another."""
    total = int(size.sum())
    if not total:
        return values[:0]
    before = np.cumsum(size) - size
    return values[np.arange(total) + np.repeat(start - before, size)]


def encode_decode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, buckets: int | None = None) -> DataFrame:
    """The kept columns, n_tokens, token_ids (array<int>) and decoded: the text that the ids give back.

    vocabulary: the path of a rank file. Kept columns named like these results come with an underscore after.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("bigint"))).first()[0] or 0
        buckets = max(8, -(-size // BUCKET_BYTES))
    sent = spark.sparkContext.broadcast(Vocabulary(vocabulary or default_vocabulary()))
    results = {"n_tokens", "token_ids", "decoded"}
    names = [c + "_" * (c.lower() in results) for c in keep]
    (own,) = fresh(docs, "whole_text")
    table = docs.select(F.col(f"`{text}`").cast("string").alias(own), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))

    def blocks(batches):
        from pyspark import TaskContext

        def out(rows):
            while part := list(islice(rows, 64)):
                yield one(part)

        def one(rows):
            key, block, bucket, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], ["key", "block", "bucket", "data"])

        task, k, b = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            # Copied: a column as it comes would hold on to its whole batch, the texts with it.
            texts, rest = batch.column(0), batch.select(names).take(pa.array(np.arange(len(batch))))
            for at in range(0, len(texts), 1024):
                b.add(rest.slice(at, 1024), texts.slice(at, 1024))
                if b.bytes >= BLOCK_BYTES:
                    yield from out(b.pieces(task, k, buckets))
                    k, b = k + 1, _Block()
            del batch, texts, rest
            trim()
        if b.sizes:
            yield from out(b.pieces(task, k, buckets))
        del b
        trim()

    def encode(t: pa.Table) -> pa.Table:
        rows = t.to_pydict()
        words = [(x, d) for x, y, d in zip(rows["block"], rows["bucket"], rows["data"]) if y >= 0]
        got = [(x, -1, d) for x, y, d in zip(rows["block"], rows["bucket"], rows["data"]) if y < 0]
        got += [(x, rows["key"][0], d) for x, d in _encode_bucket(sent.value, words)]
        block, bucket, data = zip(*got)
        trim()
        return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*names).schema.fields), "n_tokens int", "token_ids array<int>", "decoded string"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, data = [], []
        for batch in batches:
            bucket += batch["bucket"].to_pylist()
            data += batch["data"].to_pylist()
        (flow, sizes, parts), meta = _unpack(data[bucket.index(-1)], 3)
        if len(bucket) != parts[0] + 1:
            raise RuntimeError(f"a block has {len(bucket) - 1} of {parts[0]} word buckets: the input isn't the same on each run")
        rows = pa.ipc.open_stream(zstandard.decompress(meta)).read_all()
        whose, size, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for k, d in zip(bucket, data):
            if k >= 0:
                (gaps, s, i), _ = _unpack(d, 3)
                # Differences as 32-bit numbers wrap; so do their sums.
                whose.append(np.cumsum(gaps, dtype=np.uint32).astype(np.int64)), size.append(s), ids.append(i)
        whose, size, ids = np.concatenate(whose), np.concatenate(size).astype(np.int64), np.concatenate(ids).astype(np.int32)
        at = np.cumsum(size) - size
        start, length = np.zeros(len(whose), np.int64), np.zeros(len(whose), np.int64)
        start[whose], length[whose] = at, size
        none = sizes == 0xFFFFFFFF
        count = np.where(none, 0, sizes).astype(np.int64)
        ends = np.cumsum(count)
        del data
        table, row = sent.value.token_array(), 0
        while row < len(count):
            # Some documents at a time, so that only a share of the block's tokens is expanded at once.
            to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + 250_000, "right")))
            a, b = int(ends[row - 1]) if row else 0, int(ends[to - 1])
            n = length[flow[a:b]]
            tokens = _ragged(ids, start[flow[a:b]], n)
            per = np.zeros(b - a + 1, np.int64)
            np.cumsum(n, out=per[1:])
            cuts = np.concatenate([[0], per[ends[row:to] - a]])
            back = table.take(pa.array(tokens))
            where = np.frombuffer(back.buffers()[1], np.int64, len(back) + 1)[cuts]
            mask = pa.array(none[row:to])
            raw = pa.LargeStringArray.from_buffers(to - row, pa.py_buffer(where.astype(np.int64)), back.buffers()[2] or pa.py_buffer(b""))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int32()))
            part = rows.slice(row, to - row)
            yield from pa.table([*part.columns, pc.if_else(mask, None, pa.array(np.diff(cuts), pa.int32())), pc.if_else(mask, None, lists), pc.if_else(mask, None, raw.cast(pa.string()))], names=[*names, "n_tokens", "token_ids", "decoded"]).combine_chunks().to_batches()
            row = to
        del flow, ids, rows
        trim()

    words = table.mapInArrow(blocks, "key bigint, block bigint, bucket bigint, data binary")
    ids = words.groupBy("key").applyInArrow(encode, "block bigint, bucket bigint, data binary")
    return ids.groupBy("block").applyInArrow(assemble, schema)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_bpe_codec": op6_bpe_codec}
ORACLES: dict[str, str] = {}

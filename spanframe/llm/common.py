"""What the corpus operators share: lineage cuts, Arrow text buffers and vectorized word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
#: Bytes of text that one vectorized step works on; bounds a Python worker's memory, not its input.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local one where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "spanframe-shared")
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; an executor's loss then costs no recomputation of what came before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written there, if anything."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, and would keep it from the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        k = n
        while k.lower() in taken:
            k += "_"
        taken.add(k.lower())
        out.append(k)
    return out


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about size bytes, at least a row each, with the index of the first row."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset:]
    at, n = 0, len(texts)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
        yield at, texts.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the rows' offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset:]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0]:offs[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses, mod 2**64, for the exponents under n."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_MULT, _INVERSE):
            p = np.empty(n, U64)
            p[0], have, step = 1, 1, base
            while have < n:
                more = min(have, n - have)
                p[have:have + more] = p[:more] * U64(step)
                have, step = have + more, step * step % (1 << 64)
            made.append(p)
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8; ASCII punctuation and control characters become spaces."""
    out = _FOLD[data]
    if len(data) > 1:
        lead = data[:-1] == 0xC3
        tail = data[1:]
        up = np.flatnonzero(lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97))
        out[up + 1] += 0x20
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of each run without ASCII white space; a row's end ends a word. All in byte positions."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, U64)
    inside = ~_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | border[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, s, "right") - 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return s, e, row, mix((total[e] - total[s]) * down[s])

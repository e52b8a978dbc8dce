"""Dense kernels: as Columns over ARRAY<DOUBLE> for small widths, and in numpy for the encoders."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.ids import feature_hash

# Columns


def dot(x: Column, w: list[float]) -> Column:
    """x . w, the weights being part of the plan."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def linear(x: Column, w: list[list[float]], b: list[float]) -> Column:
    return F.array(*[dot(x, row) + F.lit(float(c)) for row, c in zip(w, b, strict=True)])


def let(value: Column, body) -> Column:
    """body(value) with value computed once: in a lambda an expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def softmax(x: Column, temperature: float = 1.0) -> Column:
    z = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v - top) / F.lit(float(temperature)))))
    return let(z, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, u: s + u), lambda total: F.transform(e, lambda v: v / total)))


def argmax(x: Column) -> Column:
    """The first maximum's index."""
    return F.array_position(x, F.array_max(x)) - 1


def maxout(x: Column, w: list[list[list[float]]], b: list[list[float]]) -> Column:
    """(outputs, pieces, inputs) weights; the largest piece of each output."""
    return F.array(*[F.greatest(*[dot(x, p) + F.lit(float(c)) for p, c in zip(ws, bs)]) if len(ws) > 1 else dot(x, ws[0]) + F.lit(float(bs[0])) for ws, bs in zip(w, b)])


def layer_norm(x: Column, gain: list[float], bias: list[float]) -> Column:
    """Population variance and 1e-8."""
    n = F.size(x).cast("double")
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    centred = let(mean, lambda m: F.transform(x, lambda v: v - m))
    unit = let(centred, lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v) / n + F.lit(1e-8)), lambda sd: F.transform(c, lambda v: v / sd)))
    scaled = F.zip_with(unit, F.array(*[F.lit(float(g)) for g in gain]), lambda a, g: a * g)
    return F.zip_with(scaled, F.array(*[F.lit(float(c)) for c in bias]), lambda a, c: a + c)


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def concatenate(*xs: Column) -> Column:
    return F.concat(*xs)


def expand_window(table: DataFrame, vector: str, width: int, w: int, by: str, order: str, into: str) -> DataFrame:
    """The vectors of w rows before, the row and w rows after, zeros beyond the sequence's ends."""
    over = Window.partitionBy(by).orderBy(order)
    zeros = F.array(*[F.lit(0.0)] * width)
    parts = [F.coalesce(F.lag(vector, -k).over(over) if k else F.col(vector), zeros) for k in range(-w, w + 1)]
    return table.withColumn(into, F.concat(*parts))


def lookup(table: DataFrame, key: str, vectors: DataFrame, width: int, into: str) -> DataFrame:
    """Static vectors by key, zeros for an unknown one; vectors: (key, vector)."""
    v = vectors.select(F.col("key").alias("vector_key"), F.col("vector").alias(into))
    return table.join(v, F.col(key) == F.col("vector_key"), "left").drop("vector_key").withColumn(into, F.coalesce(into, F.array(*[F.lit(0.0)] * width)))


def span_schedule(table: DataFrame, window: int, stride: int, size: str = "n") -> DataFrame:
    """(.., start, end) of strided windows over size rows; none over no rows, and none after the one that reaches the end."""
    x = table.where(F.col(size) > 0).withColumn("start", F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(stride))))
    return x.where((F.col("start") == 0) | (F.col("start") + window - stride < F.col(size))).withColumn("end", F.least(F.col("start") + window, F.col(size)))


def mean_pool(pieces: DataFrame, keys: list[str], vector: str, width: int, into: str) -> DataFrame:
    """The mean of the vectors that belong to a key, by the positions in them; no row for a key without any."""
    return pieces.groupBy(*keys).agg(F.array(*[F.avg(F.element_at(vector, k + 1)) for k in range(width)]).alias(into))


# numpy, float32 as the models are


def np_hash_embed(ids: np.ndarray, seed: int, table: np.ndarray) -> np.ndarray:
    """The sum of the four rows that an id's buckets choose."""
    return table[feature_hash(ids, seed) % np.uint32(len(table))].sum(1, dtype=np.float32)


def hash_embed(id_: Column, seed: int, table: np.ndarray) -> Column:
    """np_hash_embed() of a column of ids; the table is sent with the plan, so it is a small one."""

    def run(a: pa.Array) -> pa.Array:
        x = np_hash_embed(a.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), seed, table.astype(np.float32))
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), table.shape[1]).cast(pa.list_(pa.float32()))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")(id_)


def np_linear(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ w.T + b


def np_maxout(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.einsum("ni,opi->nop", x, w, optimize=True) + b).max(2)


def np_layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mu = x.mean(1, keepdims=True)
    return (x - mu) / np.sqrt(x.var(1, keepdims=True) + np.float32(1e-8)) * gain + bias


def np_softmax(x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = np.exp((x - x.max(1, keepdims=True)) / temperature)
    return z / z.sum(1, keepdims=True)


def np_expand_window(x: np.ndarray, w: int, lengths: list[int]) -> np.ndarray:
    out, at = [], 0
    for n in lengths:
        p = np.pad(x[at:at + n], ((w, w), (0, 0)))
        out.append(np.concatenate([p[k:k + n] for k in range(2 * w + 1)], 1))
        at += n
    return np.concatenate(out) if out else np.zeros((0, x.shape[1] * (2 * w + 1)), x.dtype)


def np_precompute(x: np.ndarray, w: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """(1 + rows, features, outputs, pieces): every row in every feature's place; row 0 stands for no token. w: (features, outputs, pieces, inputs)."""
    return np.concatenate([pad[None], np.einsum("ni,fopi->nfop", x, w, optimize=True)])


def np_state_hidden(cache: np.ndarray, features: list[int], bias: np.ndarray) -> np.ndarray:
    """The hidden layer of a state whose features are token numbers, negative for none."""
    return reduce(np.add, [cache[max(f, -1) + 1, k] for k, f in enumerate(features)], bias).max(1)


def np_pool(vectors: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Mean of the pieces' vectors by the token that owns them (negative: none); zeros without pieces."""
    out, ok = np.zeros((rows, vectors.shape[1]), np.float32), owner >= 0
    np.add.at(out, owner[ok], vectors[ok])
    return out / np.maximum(np.bincount(owner[ok], minlength=rows), 1)[:, None].astype(np.float32)


def np_batches(spans: list[np.ndarray], pad: int, size: int = 8):
    """(ids, mask) of at most size spans each, padded to the longest of the batch."""
    for at in range(0, len(spans), size):
        part = spans[at:at + size]
        n = max(map(len, part))
        yield np.stack([np.pad(s, (0, n - len(s)), constant_values=pad) for s in part]), np.stack([np.arange(n) < len(s) for s in part])


def spans_of(n: int, window: int, stride: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < n:
        out.append((at, min(at + window, n)))
        if out[-1][1] == n:
            break
        at += stride
    return out


def window_of(inputs: int, outputs: int) -> int:
    """How far a convolution looks, from its layers' widths."""
    k, rest = divmod(inputs, outputs)
    if rest or k < 3 or k % 2 == 0:
        raise ValueError(f"no convolution has {inputs} inputs for {outputs} outputs")
    return (k - 1) // 2

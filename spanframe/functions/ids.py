"""String ids: 64-bit MurmurHash64A with seed 1, fixed ids of built-in symbols, and the four-bucket feature hash.

Spark has no unsigned 64-bit type: ids are BIGINT with the same bits, and unsigned() shows them as decimals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M = np.uint64(0xC6A4A7935BD1E995)
_R = np.uint64(47)
EMPTY_HASH = 14313749767032693980

_FLAG_NAMES = "IS_ALPHA IS_ASCII IS_DIGIT IS_LOWER IS_PUNCT IS_SPACE IS_TITLE IS_UPPER LIKE_URL LIKE_NUM LIKE_EMAIL IS_STOP IS_OOV_DEPRECATED IS_BRACKET IS_QUOTE IS_LEFT_PUNCT IS_RIGHT_PUNCT IS_CURRENCY".split()
_CORE_NAMES = "ID ORTH LOWER NORM SHAPE PREFIX SUFFIX LENGTH CLUSTER LEMMA POS TAG DEP ENT_IOB ENT_TYPE HEAD SENT_START SPACY PROB LANG ADJ ADP ADV AUX CONJ CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X EOL SPACE".split()
_HIGH_NAMES = "PERSON NORP FACILITY ORG GPE LOC PRODUCT EVENT WORK_OF_ART LANGUAGE LAW DATE TIME PERCENT MONEY QUANTITY ORDINAL CARDINAL acomp advcl advmod agent amod appos attr aux auxpass cc ccomp complm conj cop csubj csubjpass dep det dobj expl hmod hyph infmod intj iobj mark meta neg nmod nn npadvmod nsubj nsubjpass num number oprd obj obl parataxis partmod pcomp pobj poss possessive preconj prep prt punct quantmod relcl rcmod root xcomp acl ENT_KB_ID MORPH ENT_ID IDX _".split()
SYMBOLS = {n: k for k, n in enumerate(_FLAG_NAMES, 1)} | {n: k for k, n in enumerate(_CORE_NAMES, 64)} | {n: k for k, n in enumerate(_HIGH_NAMES, 380)}


def murmur64(data: np.ndarray, offsets: np.ndarray, seed: int = 1) -> np.ndarray:
    """The hash of each slice data[offsets[i]:offsets[i + 1]]; all slices take the same step together."""
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    h = np.uint64(seed) ^ size.astype(np.uint64) * _M
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live = np.flatnonzero(size >= 8)
    at = 0
    while len(live):
        k = np.ascontiguousarray(padded[start[live, None] + at + np.arange(8)]).view("<u8").ravel() * _M
        k = (k ^ (k >> _R)) * _M
        h[live] = (h[live] ^ k) * _M
        at += 8
        live = live[size[live] >= at + 8]
    left = np.flatnonzero(size % 8)
    if len(left):
        rest = size[left] % 8
        block = padded[np.minimum((start + size - size % 8)[left, None] + np.arange(8), len(padded) - 1)].copy()
        block[np.arange(8)[None, :] >= rest[:, None]] = 0
        h[left] = (h[left] ^ np.ascontiguousarray(block).view("<u8").ravel()) * _M
    h = (h ^ (h >> _R)) * _M
    return h ^ (h >> _R)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + a.offset + 1)[a.offset:]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def hash_strings(texts: pa.Array) -> pa.Array:
    """Raw hashes; the empty string's isn't 0."""
    data, offsets = _buffers(texts)
    return pa.array(murmur64(data, offsets).view(np.int64), mask=np.asarray(texts.is_null()))


def symbol_id(text: str) -> int | None:
    """The fixed id of a built-in symbol."""
    if text in SYMBOLS:
        return SYMBOLS[text]
    if m := re.fullmatch(r"FLAG(0|[1-9][0-9]*)", text):
        return int(m[1]) if 19 <= int(m[1]) <= 63 else None
    if m := re.fullmatch(r"DEPRECATED([0-9]{3})", text):
        return int(m[1]) + 103 if 0 < int(m[1]) <= 276 else None
    return None


def string_id_of(text: str) -> int:
    """One string's id, unsigned: 0 for the empty one, a symbol's own, else the hash."""
    if not text:
        return 0
    k = symbol_id(text)
    raw = text.encode()
    return k if k is not None else int(murmur64(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


def ids_of(texts: pa.Array) -> np.ndarray:
    """The ids of many strings as BIGINT: each distinct one is hashed once; null counts as empty."""
    coded = texts.fill_null("").dictionary_encode()
    words = coded.dictionary
    out = murmur64(*_buffers(words)).view(np.int64)
    named = pa.compute.or_(pa.compute.is_in(words, pa.array(["", *SYMBOLS])), pa.compute.match_substring_regex(words, r"\A(?:FLAG|DEPRECATED)[0-9]"))
    for k in np.flatnonzero(np.asarray(named)):
        out[k] = np.uint64(string_id_of(words[int(k)].as_py())).astype(np.int64)
    return out[np.asarray(coded.indices)]


def string_hash(t: Column) -> Column:
    return F.arrow_udf(hash_strings, "bigint")(t)


def string_id(t: Column) -> Column:
    """A Column of ids; built-in symbols are literals of the plan, only the rest is hashed."""
    table = F.create_map(*[F.lit(x) for p in SYMBOLS.items() for x in p])
    flag = F.regexp_extract(t, r"\AFLAG(1[9]|[2-5][0-9]|6[0-3])\z", 1).try_cast("bigint")
    old = F.regexp_extract(t, r"\ADEPRECATED([0-9]{3})\z", 1).try_cast("bigint")
    old = F.when(old.between(1, 276), old + 103)
    # A map is searched entry by entry, a set is not: few strings are symbols.
    known = F.when(t.isin(*SYMBOLS), F.try_element_at(table, t).cast("bigint"))
    flag, old = F.when(t.startswith("FLAG"), flag), F.when(t.startswith("DEPRECATED"), old)
    return F.when(t == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(known, flag, old, string_hash(t)))


def string_ids(texts: Column) -> Column:
    """The id of each string of an array."""

    def run(a: pa.Array) -> pa.Array:
        flat = a.flatten()
        made = pa.array(ids_of(flat), mask=np.asarray(flat.is_null()))
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(a), 0))
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), made)
        return pa.compute.if_else(a.is_null(), None, out)

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(texts)


def unsigned(id_: Column) -> Column:
    """The BIGINT's bits as an unsigned decimal."""
    return F.conv(F.hex(id_), 16, 10).cast("decimal(20,0)")


def rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _fmix(x: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def feature_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """(n x 4) 32-bit buckets of unsigned 64-bit ids: the 128-bit x64 Murmur3 of eight bytes."""
    s = np.uint64(seed)
    a = rotl(ids.astype(np.uint64) * np.uint64(0x87C37B91114253D5), 31) * np.uint64(0x4CF5AD432745937F)
    a = a ^ s ^ np.uint64(8)
    b = np.full_like(a, s ^ np.uint64(8))
    a = a + b
    b = b + a
    a, b = _fmix(a), _fmix(b)
    a = a + b
    b = b + a
    return np.stack([a & np.uint64(0xFFFFFFFF), a >> np.uint64(32), b & np.uint64(0xFFFFFFFF), b >> np.uint64(32)], 1).astype(np.uint32)


def hash_buckets(id_: Column, seed: int) -> Column:
    def run(a: pa.Array) -> pa.Array:
        x = feature_hash(a.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), seed).astype(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.int64()))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(id_)


class Strings:
    """A store of strings by id, on the driver: adding is idempotent, and two strings with one id are an error."""

    def __init__(self, texts=()):
        self._texts: dict[int, str] = {}
        for t in texts:
            self.add(t)

    def add(self, text: str) -> int:
        k = string_id_of(text)
        if k and self._texts.setdefault(k, text) != text:
            raise ValueError(f"{text!r} and {self._texts[k]!r} have the same id {k}")
        return k

    def get(self, k: int) -> str | None:
        return "" if k == 0 else self._texts.get(k)

    def __contains__(self, k: int) -> bool:
        return k == 0 or k in self._texts

    def __iter__(self):
        return iter(self._texts.items())

    def __len__(self) -> int:
        return len(self._texts)


def intern(spark: SparkSession, texts: DataFrame, column: str) -> DataFrame:
    """(id, text) of the distinct non-empty strings; collisions() of it must be empty."""
    return texts.select(F.col(f"`{column}`").alias("text")).where("text is not null and text <> ''").distinct().select(string_id(F.col("text")).alias("id"), "text")


def collisions(table: DataFrame) -> DataFrame:
    return table.groupBy("id").agg(F.count_distinct("text").alias("n")).where("n > 1")

"""Byte-level BPE in numpy: pre-tokens as ragged arrays, whose lowest-rank pairs are merged in step."""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex

from spanframe.llm.common import U64

NONE = np.int32(0x7FFFFFFF)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXACT = regex.compile(PATTERN)
# The standard library's classes agree with the pattern's on these code points, and it is faster there.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_vocabulary() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pretokens(text: str) -> list[str]:
    """The pieces of a text that no merge crosses; joined, they are the text."""
    return (_FAST if _PLAIN.fullmatch(text) else _EXACT).findall(text)


# Of the bytes of plain texts: letters (all beyond ASCII are, in _PLAIN), digits, white space, others.
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 13, 32]] = _SPACE
# Bytes that _PLAIN has no code point for.
_STRANGE = np.ones(256, bool)
_STRANGE[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which the pretokens() of texts begin. data: their UTF-8 bytes one after another; offsets: of the texts, and the end.

    In texts of _PLAIN, runs of a kind are pre-tokens but for this: the last white space of several before something is
    one of its own, and goes with what follows if it is a space; a contraction ends within its letters.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, edge = _KIND[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    out = edge[:n].copy()
    out[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(out)
    stop = np.append(run[1:], n)
    of, inner = kind[run], ~edge[stop]
    space = stop[(of == _SPACE) & inner]
    before = run[(of == _SPACE) & inner]
    out[space[space - before > 1] - 1] = True
    out[space[data[space - 1] == 32]] = False
    k = np.flatnonzero((data[run] == 39) & (stop - run == 1) & inner & out[run])
    k = k[of[k + 1] == _LETTER]
    at, end = run[k], stop[k + 1]
    c, d = data[at + 1], data[np.minimum(at + 2, n - 1)]
    size = 2 * np.isin(c, np.frombuffer(b"stmd", np.uint8))
    size += 3 * ((at + 2 < end) & (((c == 114) | (c == 118)) & (d == 101) | (c == 108) & (d == 108)))
    at, end, size = (z[size > 0] for z in (at, end, size))
    out[at + 1] = False
    more = at + size < end
    out[(at + size)[more]] = True
    strange = _STRANGE[data]
    lead = (data >= 0xC3) & (data <= 0xC9)
    tail = (data >= 0x80) & (data < 0xC0)
    strange[1:] |= tail[1:] != lead[:-1]
    strange[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC9) & (data[1:] > 0x8F)
    for r in np.unique(np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1).tolist():
        a, b = int(offsets[r]), int(offsets[r + 1])
        out[a:b] = False
        size = np.fromiter((len(w.encode()) for w in pretokens(data[a:b].tobytes().decode())), np.int64)
        out[a + np.cumsum(size) - size] = True
    return np.flatnonzero(out)


class Vocabulary:
    """Ranks of byte sequences and the table of pairs that merge; small and of a fixed size, so it can be broadcast."""

    def __init__(self, path: str):
        self.tokens: list[bytes] = []
        ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.width = len(self.tokens)
        keys, values = [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b), values.append(r)
        self._table(np.array(keys, np.int64), np.array(values, np.int32))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table with linear probing, filled and read by whole arrays."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what a and b make together, NONE where they don't merge."""
        key = a.astype(np.int64) * self.width + b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot = (slot[left] if len(slot) == len(key) else slot) + 1 & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            left, slot = left[go], slot[go]
        return out

    def token_array(self) -> pa.Array:
        """The token-byte table: the bytes of each id."""
        return pa.array(self.tokens, pa.large_binary())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all sequences one after another, and the sequences' offsets in them.

        In each round every sequence that can still merge merges all the places of its own lowest-rank pair at once, from the left where they overlap.
        """
        n = len(offsets) - 1
        size = np.diff(offsets)
        sym, word = self.bytes[data], np.repeat(np.arange(n), size)
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        done_ids, done_words = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            per = np.repeat(low, np.diff(np.append(first, len(sym))))
            over = per == NONE
            if over.any():
                done_ids.append(sym[over]), done_words.append(word[over])
                stay = ~over
                sym, word, rank, per = sym[stay], word[stay], rank[stay], per[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == per)
            # Of hits in a row every other one merges, from the first.
            head = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            k = np.arange(len(hit))
            hit = hit[(k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0]
            sym[hit] = rank[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            look = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = look + 1 >= len(sym)
            rank[look[last]] = NONE
            look = look[~last]
            same = word[look] == word[look + 1]
            rank[look[~same]] = NONE
            look = look[same]
            rank[look] = self.pair_ranks(sym[look], sym[look + 1])
        ids = np.concatenate([*done_ids, np.zeros(0, np.int32)])
        words = np.concatenate([*done_words, np.zeros(0, np.int64)])
        ids = ids[np.argsort(words, kind="stable")]
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(words, minlength=n), out=out[1:])
        return ids, out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of strings."""
        joined = [w.encode() for w in words]
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)), out=offsets[1:])
        return self.encode(np.frombuffer(b"".join(joined), np.uint8), offsets)

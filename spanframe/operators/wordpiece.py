"""Word pieces for a transformer encoder, and the encoder's interface: the network itself is the application's."""

from __future__ import annotations

import unicodedata
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def load_vocabulary(text: str) -> dict[str, int]:
    """A piece a line; its number is its id. The four special pieces must be there."""
    v = {line: k for k, line in enumerate(text.splitlines())}
    if missing := [s for s in SPECIALS if s not in v]:
        raise ValueError(f"the vocabulary lacks {missing}")
    return v


def normalize(token: str, lower: bool = True, nfkc: bool = True) -> str:
    token = token.lower() if lower else token
    return unicodedata.normalize("NFKC", token) if nfkc else token


def encode_word(word: str, vocabulary: dict[str, int], longest: int = 100) -> tuple[list[int], bool]:
    """(ids, aligned): the longest pieces from the left; a word that is too long or has none is unknown, and not aligned."""
    ids, at = [], 0
    while at < len(word) <= longest:
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                ids.append(vocabulary[piece])
                at = end
                break
        else:
            return [vocabulary["[UNK]"]], False
    return (ids, True) if at == len(word) and ids else ([vocabulary["[UNK]"]], False)


def encode_span(tokens: list[str], vocabulary: dict[str, int], lower: bool = True, nfkc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner): the pieces of a span between its marks, and the token each belongs to, -1 for none."""
    ids, owner = [vocabulary["[CLS]"]], [-1]
    for k, t in enumerate(tokens):
        word = normalize(t, lower, nfkc)
        if not word or word.isspace():
            continue
        got, aligned = encode_word(word, vocabulary)
        ids += got
        owner += [k if aligned else -1] * len(got)
    return np.array([*ids, vocabulary["[SEP]"]]), np.array([*owner, -1])


def word_ids(text: Column, vocabulary: dict[str, int], lower: bool = True, nfkc: bool = True) -> Column:
    """STRUCT(ids, aligned) of a token; white space has no pieces. Each distinct token of a batch is cut once."""

    def run(a: pa.Array) -> pa.Array:
        a = a.fill_null("").dictionary_encode() if not pa.types.is_dictionary(a.type) else a
        made = []
        for t in a.dictionary.to_pylist():
            word = normalize(t, lower, nfkc)
            made.append(([], False) if not word or word.isspace() else encode_word(word, vocabulary))
        table = pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([y for _, y in made], pa.bool_())], ["ids", "aligned"])
        return table.take(a.indices)

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<ids: array<int>, aligned: boolean>")(text)


class TransformerEncoder(Protocol):
    """What an application supplies: vectors (rows x width) of each document's tokens."""

    def encode_batch(self, documents: list[list[str]]) -> list[np.ndarray]: ...


def check_vectors(documents: list[list[str]], vectors: list[np.ndarray], width: int) -> None:
    if len(documents) != len(vectors):
        raise ValueError("the encoder gave another number of documents")
    for d, v in zip(documents, vectors):
        if v.shape != (len(d), width):
            raise ValueError(f"the encoder gave {v.shape} for {len(d)} tokens of width {width}")

"""Token counts of whole texts under a byte-level BPE vocabulary, without keeping the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.bpe import Vocabulary, default_vocabulary, pretokens
from spanframe.llm.common import text_chunks, trim

#: Pre-tokens whose counts a worker remembers between chunks; it bounds memory only.
REMEMBERED = 400_000


def count_texts(texts: pa.Array, vocabulary: Vocabulary, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each text; known: counts of pre-tokens so far."""
    tokens, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for at, part in text_chunks(texts):
        split = [pretokens(t) if t else [] for t in part.to_pylist()]
        new = list({w for ws in split for w in ws if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for ws in split for w in ws})
        _, offsets = vocabulary.encode_words(new)
        known.update(zip(new, np.diff(offsets).tolist()))
        get = known.__getitem__
        tokens[at:at + len(part)] = [sum(map(get, ws)) for ws in split]
        pieces[at:at + len(part)] = [len(ws) for ws in split]
    return tokens, pieces


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_bytes) for every row, in place: no shuffle, and only these two columns are read.

    A null text has null counts, an empty one zeros; rows that repeat are counted each; other columns don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary or default_vocabulary()))

    def count(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, known = sent.value, {}
        for texts in it:
            t, p = count_texts(texts, vocabulary, known)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array(t)], ["p", "t"])
            del texts
            trim()

    counted = F.arrow_udf(count, "struct<p: bigint, t: bigint>")
    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    x = x.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("text").isNull().alias("none"), counted("text").alias("c"))
    return x.select("doc_id", F.when(~F.col("none"), F.col("c.p")).alias("n_pretokens"), F.when(~F.col("none"), F.col("c.t")).alias("n_tokens"), "n_bytes")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}

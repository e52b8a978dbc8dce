"""A corpus pipeline of documents: each stage is written as Parquet and read again by the next.

Stages, each over all that the one before kept: language ID (documents in which no language is found go), SimHash
near-dedup (one document of each group stays), secret scans (the secrets' spans are replaced), mixing (documents are
repeated or sampled to their source's weight), and byte-level BPE (token ids, and the text that they decode to).

Defined results, whatever the order or number of partitions: rows with null, empty or wordless texts end at the first stage, as no
language is found in them; null ids and sources are values like others, but a row without doc_id is never a near copy; texts of
any length are taken whole; rows that repeat are one after near-dedup if they have a doc_id; an empty table gives an empty one; columns
beyond those of documents are carried up to the last stage, whatever their names. Each stage's docstring adds to this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanframe.llm.bpe_codec import encode_decode
from spanframe.llm.common import discard, scratch
from spanframe.llm.language_id import keep_identified
from spanframe.llm.mixing import mix_sources
from spanframe.llm.secret_scan import redact_secrets
from spanframe.llm.simhash_dedup import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was identified: with letters, and a score that a text of their length reaches."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; of rows that share a doc_id each is told by its text."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] for the secrets in their texts, and n_chars of the new texts; others stay as they are."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the equal weights of their sources say, within the size that the corpus has; a seed and the doc_id draw."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, token_ids and the decoded text of every row."""
    return encode_decode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("secret_scan", secrets), ("source_mixing", mixing), ("bpe_codec", tokens)]
# A trained classifier, fingerprints and token merges can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents. What a stage wrote is deleted when the next one's is there; the last one's stays."""
    docs, at, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        made, out = stage(spark, docs, sf_dir), f"{at}/{k}-{name}"
        made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
        if before:
            discard(spark, before)
        before = out
    return docs

"""Sentence starts as windows over the flat token table: 1 a start, -1 none, 0 not said."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import lexical
from spanframe.operators.tokens import before, by_doc

PUNCT_CHARS = (".", "!", "?", "…", "。", "！", "？", "｡", "．", "؟", "۔", "।", "॥", "։")


def sentence_starts(tokens: DataFrame, terminals=PUNCT_CHARS, overwrite: bool = False) -> DataFrame:
    """tokens with sent_start. The first content token after a terminal starts a sentence; content is neither terminal nor
    all punctuation. A terminal equals a token's whole text. What was said before stays unless overwrite."""
    terminal = F.col("text").isin(*terminals) if terminals else F.lit(False)
    content = ~terminal & ~lexical.is_punct(F.col("text"))
    ended = F.last(F.when(terminal, F.col("i")), ignorenulls=True).over(before())
    # The last content token before: a terminal after it hasn't been answered yet.
    said = F.last(F.when(content, F.col("i")), ignorenulls=True).over(before())
    start = (F.col("i") == 0) | (content & ended.isNotNull() & (ended > F.coalesce(said, F.lit(-1))))
    return with_policy(tokens, F.when(start, 1).otherwise(-1), overwrite)


def with_policy(tokens: DataFrame, value: Column, overwrite: bool) -> DataFrame:
    """Write sent_start where it is 0, or everywhere."""
    if "sent_start" not in tokens.columns or overwrite:
        return tokens.withColumn("sent_start", value)
    return tokens.withColumn("sent_start", F.when(F.col("sent_start") == 0, value).otherwise(F.col("sent_start")))


def starts_from_classes(tokens: DataFrame, klass: str, overwrite: bool = False) -> DataFrame:
    """A classifier's class 1 starts a sentence."""
    return with_policy(tokens, F.when(F.col(klass) == 1, 1).otherwise(-1), overwrite)


def document_start(tokens: DataFrame) -> DataFrame:
    """Without a component: the first token starts a sentence, nothing is said of the others."""
    return tokens.withColumn("sent_start", F.when(F.col("i") == 0, 1).otherwise(F.lit(0) if "sent_start" not in tokens.columns else F.col("sent_start")))


def sentences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence, start, end, start_char, end_char): runs of tokens from a start to the next."""
    x = tokens.withColumn("sentence", F.sum(F.when(F.col("sent_start") == 1, 1).otherwise(0)).over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("doc_id", "sentence").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.min("idx").alias("start_char"), F.max(F.col("idx") + F.length("text")).alias("end_char"))


def starts_from_heads(tokens: DataFrame) -> DataFrame:
    """sent_start from heads (relative, 0 a root): the left edge of each root's tokens. Documents are groups, in which
    pointer jumping halves the way to the roots in each round; a head that leaves the document or turns in a circle is an error."""
    names = [c for c in tokens.columns if c != "sent_start"]
    schema = tokens.select(*names).withColumn("sent_start", F.lit(0)).schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        i = t["i"].to_numpy()
        head = t["head"].to_numpy()
        up = np.searchsorted(i, i + head)
        if len(i) and ((up >= len(i)).any() or (i[np.minimum(up, len(i) - 1)] != i + head).any()):
            raise ValueError("a head is outside of its document")
        for _ in range(max(1, len(i)).bit_length() + 1):
            up = up[up]
        if head[up].any():
            raise ValueError("heads turn in a circle")
        starts = np.full(len(i), -1, np.int32)
        starts[np.unique(up, return_index=True)[1]] = 1
        return t.append_column("sent_start", pa.array(starts))

    return tokens.select(*names).groupBy("doc_id").applyInArrow(run, schema)


def choose(has_parser: bool, has_classifier: bool, has_rules: bool) -> str:
    """Which component says where sentences start."""
    if has_classifier and has_rules:
        raise ValueError("a sentence classifier and a rule sentencizer exclude each other")
    return "parser" if has_parser else "classifier" if has_classifier else "rules" if has_rules else "first"

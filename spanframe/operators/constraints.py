"""Preset annotations: what is known of spans before a recognizer runs, as a table joined to the tokens.

A constraint is (doc_id, kind, start, end, label, alignment): entity, blocked, outside or missing over a token range; the
same with char_ before it over a character range with an alignment; or default with a label of outside, missing, blocked or unmodified.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators import tokens as T
from spanframe.operators.ruler import with_entities

SCHEMA = "doc_id bigint, kind string, start int, end int, label string, alignment string"
KINDS = ("entity", "blocked", "outside", "missing")


def parse(text: str, doc_id: int = 0) -> tuple:
    """START:END:LABEL; for a label, - is blocked, ? missing and O outside."""
    m = re.fullmatch(r"(\d+):(\d+):(.+)", text)
    if not m:
        raise ValueError(f"not START:END:LABEL: {text!r}")
    kind = {"-": "blocked", "?": "missing", "O": "outside"}.get(m[3], "entity")
    return doc_id, kind, int(m[1]), int(m[2]), m[3] if kind == "entity" else None, None


def parse_table(rows: DataFrame, column: str = "constraint") -> DataFrame:
    """The constraints of (doc_id, column) of strings as parse() reads them; one that isn't START:END:LABEL is an error."""
    part = lambda k: F.regexp_extract(column, r"(?s)\A([0-9]+):([0-9]+):(.+)\z", k)
    label = F.when(part(3) == "", F.raise_error(F.concat(F.lit("not START:END:LABEL: "), F.col(column))).cast("string")).otherwise(part(3))
    x = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), part(1).try_cast("int").alias("start"), part(2).try_cast("int").alias("end"), label.alias("l"))
    kind = F.when(F.col("l") == "-", "blocked").when(F.col("l") == "?", "missing").when(F.col("l") == "O", "outside").otherwise("entity")
    return x.select("doc_id", kind.alias("kind"), "start", "end", F.when(kind == "entity", F.col("l")).alias("label"), F.lit(None).cast("string").alias("alignment"))


def resolved(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Constraints with token ranges, each with the error that it makes, if any."""
    plain = wanted.where(~F.col("kind").startswith("char_") & (F.col("kind") != "default"))
    chars = wanted.where(F.col("kind").startswith("char_"))
    # Only documents that have such constraints are put together; the semi-join goes below, to the texts.
    own = chars.select("doc_id").distinct().hint("shuffle_hash")
    docs = T.nest(tokens.select("doc_id", "i", "text", "has_space", "idx").join(own, "doc_id", "left_semi"))
    x = chars.join(docs, "doc_id")
    modes = [F.when(F.coalesce("alignment", F.lit("strict")) == m, T.char_span(F.col("tokens"), F.col("start"), F.col("end"), m)) for m in ("strict", "contract", "expand")]
    x = x.withColumn("s", F.coalesce(*modes)).select("doc_id", F.expr("substring(kind, 6)").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "label", F.when(F.col("s").isNull() | (F.col("s.start") == F.col("s.end")), F.lit("unaligned character constraint")).alias("error"))
    sizes = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = plain.select("doc_id", "kind", "start", "end", "label", F.lit(None).cast("string").alias("error")).unionByName(x).join(sizes, "doc_id", "left")
    wrong = F.when((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.coalesce("n", F.lit(0))), "invalid constraint range").when((F.col("kind") == "entity") & (F.coalesce("label", F.lit("")) == ""), "empty constraint label").when(~F.col("kind").isin(*KINDS), "unknown constraint")
    return out.withColumn("error", F.coalesce("error", wrong)).drop("n")


def errors(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, error) of documents whose constraints can't be applied."""
    r = resolved(tokens, wanted)
    bad = r.where("error is not null").select("doc_id", "error")
    twice = r.where("error is null").select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).groupBy("doc_id", "i").count().where("count > 1").select("doc_id", F.lit("overlapping constraint").alias("error"))
    many = wanted.where("kind = 'default'").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("multiple constraint defaults").alias("error"))
    return bad.unionByName(twice).unionByName(many).distinct()


def apply(tokens: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """tokens with the constraints written in; strict: a document with an error fails the job, otherwise it stays as it is."""
    t = with_entities(tokens)
    bad = errors(t, wanted).groupBy("doc_id").agg(F.min("error").alias("error"))
    spans = resolved(t, wanted).where("error is null").join(bad, "doc_id", "left_anti")
    # Both are a row for each document: the tokens stay where they are.
    x = T.mark(t, spans.select("doc_id", "start", "end", "kind", "label"), "_mark")
    base = wanted.where("kind = 'default'").join(bad, "doc_id", "left_anti").select("doc_id", F.col("label").alias("base"))
    x = x.join(base.join(bad, "doc_id", "full").hint("shuffle_hash"), "doc_id", "left")
    kind = F.coalesce("_mark.kind", F.nullif(F.col("base"), F.lit("unmodified")))
    set_ = kind.isNotNull()
    iob = F.when(kind == "entity", F.when(F.col("i") == F.col("_mark.start"), 3).otherwise(1)).when(kind == "blocked", 3).when(kind == "outside", 2).when(kind == "missing", 0)
    values = {"ent_iob": F.when(set_, iob).otherwise(F.col("ent_iob")), "ent_type": F.when(set_, F.when(kind == "entity", F.col("_mark.label")).otherwise("")).otherwise(F.col("ent_type")), "ent_id": F.when(set_, "").otherwise(F.col("ent_id")), "ent_kb_id": F.when(set_, "").otherwise(F.col("ent_kb_id"))}
    if strict:
        values["ent_iob"] = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": "), F.col("error"))).cast("int")).otherwise(values["ent_iob"])
    return x.select(*[values[c].alias(c) if c in values else F.col(c) for c in t.columns])

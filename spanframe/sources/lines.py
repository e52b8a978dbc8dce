"""Line-oriented sources and sinks: raw lines, JSON strings, entity lines, token dumps and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_FIELDS = ("text", "idx", "head", "dep", "sent_start", "ent_iob", "ent_type")


def json_string(text: Column) -> Column:
    """A text as one line of JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", "$1")


def texts(source: DataFrame, json_input: bool = False, value: str = "value") -> DataFrame:
    """source with text: each line as it is, or the JSON string it holds; lines that are blank when trimmed are skipped.
    It keeps no state, so it is the same on a stream."""
    line = F.col(value)
    text = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>")[0] if json_input else line
    return source.where(~line.rlike(r"\A\p{IsWhite_Space}*\z")).withColumn("text", text).where(~F.col("text").rlike(r"\A\p{IsWhite_Space}*\z"))


def entity_lines(docs: DataFrame, entities: DataFrame, language: str = "lang") -> DataFrame:
    """(doc_id, value): {"text", "language", "entities"} of each document; one without entities has an empty list."""
    one = F.struct("text", "label", "ent_id", "start_token", "end_token", "start_char", "end_char")
    found = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_token", one.alias("e")))).alias("l"))
    kind = "array<struct<text:string,label:string,ent_id:string,start_token:int,end_token:int,start_char:int,end_char:int>>"
    x = docs.join(found, "doc_id", "left").withColumn("entities", F.coalesce(F.transform("l", lambda s: s["e"]), F.array().cast(kind)))
    return x.select("doc_id", F.to_json(F.struct("text", F.col(language).alias("language"), "entities")).alias("value"))


def entity_tsv(entities: DataFrame) -> DataFrame:
    """(value): label, text, token range and character range, split by tabs."""
    return entities.select(F.concat_ws("\t", "label", "text", F.concat_ws("..", "start_token", "end_token"), F.concat_ws("..", "start_char", "end_char")).alias("value"))


def token_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, value): the tokens of each document as JSON."""
    have = [c for c in TOKEN_FIELDS if c in tokens.columns]
    g = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*have).alias("t")))).alias("l"))
    return g.select("doc_id", F.to_json(F.struct(F.transform("l", lambda s: s["t"]).alias("tokens"))).alias("value"))


def nested_token_lines(docs: DataFrame) -> DataFrame:
    """token_lines() of tokens that are an array already."""
    have = [c for c in TOKEN_FIELDS if c in docs.schema["tokens"].dataType.elementType.names]
    return docs.select("doc_id", F.to_json(F.struct(F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in have])).alias("tokens"))).alias("value"))


def token_listing(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.col("i").alias("index"), F.col("idx").alias("start"), (F.col("idx") + F.length("text")).alias("end"), "text")


def sentence_listing(tokens: DataFrame) -> DataFrame:
    return token_listing(tokens.select("doc_id", "i", "idx", "text")).join(tokens.select("doc_id", F.col("i").alias("index"), "sent_start"), ["doc_id", "index"])


def numbered(spark, path: str) -> DataFrame:
    """(path, n, value): the lines of text files with their numbers, from 1. Files are split as usual; the lines of the splits
    before are counted first, and the table of splits, a row each, is what the numbers begin from."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = x.groupBy("path", "block").agg(F.min("row").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("path", "block", (before - F.col("first") + 1).alias("add"))
    return x.join(blocks, ["path", "block"]).select("path", (F.col("row") + F.col("add")).alias("n"), "value")


def corpus(spark, path: str) -> DataFrame:
    """(id, text) of JSON lines {"id"?, "text"}; blank lines are skipped, an id is line-N if there is none. An empty text is an
    error, and so is a path without any line."""
    x = numbered(spark, path).where("trim(value) <> ''").select("n", F.from_json("value", "id string, text string").alias("j"))
    text = F.when(F.coalesce(F.col("j.text"), F.lit("")) == "", F.raise_error(F.concat(F.lit("line "), F.col("n").cast("string"), F.lit(" has no text"))).cast("string")).otherwise(F.col("j.text"))
    out = x.select(F.coalesce("j.id", F.concat(F.lit("line-"), F.col("n").cast("string"))).alias("id"), text.alias("text"))
    if out.isEmpty():
        raise ValueError(f"{path} has no cases")
    return out


def bounded_files(spark, path: str, most: int) -> DataFrame:
    """Binary files of at most so many bytes; a longer one is an error before it is read."""
    x = spark.read.format("binaryFile").load(path)
    return x.withColumn("content", F.when(F.col("length") > most, F.raise_error(F.concat("path", F.lit(" is too large"))).cast("binary")).otherwise(F.col("content")))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)

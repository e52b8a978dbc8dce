"""Comparison of two entity tables: strict, without token numbers, and in sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("text", "label", "start_token", "end_token", "start_char", "end_char")
SEMANTIC = ("text", "label", "start_char", "end_char")


def differences(left: DataFrame, right: DataFrame, columns=STRICT) -> DataFrame:
    """(doc_id, columns, side): rows that only one table has, as often as it has them more often."""
    keys = ["doc_id", *columns]
    # Two grouped counts and a full join: a union of both sides would ask for equal partitions where they share a source.
    a = left.groupBy(*keys).agg(F.count("*").alias("l"))
    b = right.groupBy(*[F.col(k).alias(f"r_{k}") for k in keys]).agg(F.count("*").alias("r"))
    match = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    n = a.join(b, match, "full").withColumn("n", F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))).where("n <> 0")
    row = [F.when(F.col("n") > 0, F.col(k)).otherwise(F.col(f"r_{k}")).alias(k) for k in keys]
    return n.select(*row, F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("k")).drop("k")


def per_document(left: DataFrame, right: DataFrame, columns=STRICT) -> DataFrame:
    """(doc_id, left, right, mismatches): where the numbers differ, that is one mismatch; else as many as rows differ on one side."""
    n = left.groupBy("doc_id").agg(F.count("*").alias("left")).join(right.groupBy("doc_id").agg(F.count("*").alias("right")), "doc_id", "full")
    n = n.select("doc_id", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))
    d = differences(left, right, columns).where("side = 'left'").groupBy("doc_id").agg(F.count("*").alias("d"))
    return n.join(d, "doc_id", "left").select("doc_id", "left", "right", F.when(F.col("left") != F.col("right"), F.lit(1)).otherwise(F.coalesce("d", F.lit(0))).cast("bigint").alias("mismatches"))


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: documents, entities, strict and semantic mismatches, those in token numbers only, and whether all agree."""
    s = per_document(left, right).agg(F.count("*").alias("documents"), F.coalesce(F.sum("left"), F.lit(0)).alias("entities"), F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"))
    m = per_document(left, right, SEMANTIC).agg(F.coalesce(F.sum("mismatches"), F.lit(0)).alias("semantic"))
    return s.crossJoin(m).select("documents", "entities", "mismatches", "semantic", (F.col("mismatches") - F.col("semantic")).alias("token_only"), (F.col("mismatches") == 0).alias("passed"))


def token_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: documents, tokens of the left, documents whose tokens differ in number, text or place, and whether none does."""
    def digest(t, name):
        return t.groupBy("doc_id").agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64("i", "text", "idx").cast("decimal(38,0)")).alias(f"d_{name}"))

    both = digest(left, "l").join(digest(right, "r"), "doc_id", "full")
    differs = ~(F.col("n_l").eqNullSafe(F.col("n_r")) & F.col("d_l").eqNullSafe(F.col("d_r")))
    return both.agg(F.count("*").alias("documents"), F.sum(F.coalesce("n_l", F.lit(0))).cast("bigint").alias("tokens"), F.sum(differs.cast("int")).cast("bigint").alias("mismatches"), (~F.bool_or(differs)).alias("passed"))

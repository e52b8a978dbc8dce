"""Mixing sources to target weights by capped water-filling.

A source's size is the characters of its texts, its target a share of the budget in proportion to its weight. A source
whose target is over max_epochs times its size is clamped there; what it leaves is given to the others in proportion to
their weights, and so on until no target is over its cap. As sources fill up in the order of cap over weight, the last
state follows from running sums in that order. A source's epochs are its target over its size; a document comes as often as
their whole part, and once more if a number drawn from the seed and its doc_id is under their fraction.

Defined results: a null source is a source of its own; rows that repeat a doc_id draw the same number; a null doc_id draws
as the text 'null'; a null text counts 0 characters; a source without characters gets no copies by weight, so its documents
come once; sources whose weight is missing or not positive get none. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import cut, fresh

MAX_EPOCHS = 4.0
SEED = 42
#: A table of sources of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_epochs(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, text: str = "text", source: str = "source") -> DataFrame:
    """(source, docs, size, weight, epochs). weights: by source, or a table (source, weight); none: equal ones. budget: characters; none: as many as there are."""
    t = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length(F.col(f"`{text}`")).cast("bigint")), F.lit(0)).alias("size"))
    if weights is None:
        t = t.withColumn("weight", F.lit(1.0))
    else:
        if isinstance(weights, dict):
            weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        w = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
        t = t.join(w, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    cap = F.col("size") * F.lit(float(max_epochs))
    live = (F.col("size") > 0) & (F.col("weight") > 0)
    t = t.withColumn("cap", F.when(live, cap).otherwise(0.0)).withColumn("w", F.when(live, F.col("weight")).otherwise(0.0))
    t = t.withColumn("ratio", F.when(live, F.col("cap") / F.col("w")))
    # One row for each source: the only table that one task orders.
    everything, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("size").over(everything).cast("double") if budget is None else F.lit(float(budget))
    t = t.withColumn("total", total).withColumn("all_w", F.sum("w").over(everything)).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # Clamped: if those before it are, the level that the rest would have isn't under its own ratio.
    t = t.withColumn("clamped", live & ((F.col("total") - F.col("cap_before")) >= F.col("ratio") * (F.col("all_w") - F.col("w_before"))))
    t = t.withColumn("free", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)).withColumn("free_w", F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("w"))).over(everything))
    epochs = F.when(F.col("size") == 0, 1.0).when(~live, 0.0).when(F.col("clamped"), float(max_epochs)).otherwise(F.col("free") / F.col("free_w") * F.col("weight") / F.col("size"))
    return t.select("source", "docs", "size", "weight", F.round(epochs, 9).alias("epochs"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the seed and the id decide; the same in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_sources(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", copy: str | None = None) -> DataFrame:
    """The rows of docs, each as often as its source's epochs say; copy: the name of a column that numbers a row's copies from 1."""
    name, epochs, number = fresh(docs, "mix_source", "mix_epochs", copy or "mix_copy")
    plan = cut(source_epochs(docs, weights, budget, max_epochs, text, source).select(F.col("source").alias(name), F.col("epochs").alias(epochs)))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    e = F.col(epochs)
    times = (F.floor(e) + (draw(F.col(f"`{doc_id}`"), seed) < e - F.floor(e)).cast("int")).cast("int")
    out = docs.join(plan, F.col(f"`{source}`").eqNullSafe(F.col(name))).withColumn(epochs, times).where(F.col(epochs) > 0)
    out = out.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(epochs)))).drop(name, epochs)
    return out if copy else out.drop(number)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, copy="copy").select("doc_id", "source", "copy")


SQL = f"""
WITH t AS (SELECT source, count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT *, CASE WHEN size > 0 THEN size * {MAX_EPOCHS}::DOUBLE ELSE 0 END AS cap, CASE WHEN size > 0 THEN 1::DOUBLE ELSE 0 END AS w FROM t),
s AS (SELECT *, CASE WHEN size > 0 THEN cap / w END AS ratio FROM r),
u AS (SELECT *, sum(size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM s
  WINDOW b AS (ORDER BY ratio ASC NULLS LAST, source ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, size > 0 AND total - cap_before >= ratio * (all_w - w_before) AS clamped FROM u),
f AS (SELECT *, total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS free, sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS free_w FROM c),
e AS (SELECT source, round(CASE WHEN size = 0 THEN 1 WHEN clamped THEN {MAX_EPOCHS} ELSE free / free_w / size END, 9) AS epochs FROM f),
d AS (SELECT doc_id, d.source, floor(epochs)::INT + (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < epochs - floor(epochs))::INT AS times
  FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, unnest(range(1, times + 1))::INT AS copy FROM d WHERE times > 0
"""
QUERIES = {"op4_source_mixing": op4_source_mixing}
ORACLES = {"op4_source_mixing": SQL}

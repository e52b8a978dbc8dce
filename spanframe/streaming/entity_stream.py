"""Lines in, entity lines out, as a stateless stream: the batch functions on a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.operators import entities as E
from spanframe.plans.pipeline import Pipeline
from spanframe.sources import lines


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, pipeline: Pipeline, language: str = "en", json_input: bool = False):
    """Read the text files that come to source; write JSON lines to sink. A batch's output directory is named by its number,
    so that a batch that runs again after a failure replaces what it wrote."""
    stream = lines.texts(spark.readStream.text(source), json_input).select("text")

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("lang", F.lit(language)).select("doc_id", "text", "lang")
        # Written once: ids that depend on partitions must be the same for the tokens and for the documents.
        kept = f"{checkpoint}/documents/{number}"
        docs.write.mode("overwrite").parquet(kept)
        docs = spark.read.parquet(kept)
        out = lines.entity_lines(docs, E.collect(pipeline.process(docs))).select("value")
        out.write.mode("overwrite").text(f"{sink}/batch={number}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()

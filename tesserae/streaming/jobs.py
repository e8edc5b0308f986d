"""Structured Streaming counterparts: exact dedup of arriving records and a running training log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import py_split


def stream_exact_dedup(docs: DataFrame) -> DataFrame:
    """First record of each white-space-normalised text; the state is the set of digests."""
    digest = F.md5(F.array_join(py_split(F.coalesce("text", F.lit(""))), " ").cast("binary"))
    return docs.withColumn("digest", digest).dropDuplicates(["digest"])


def stream_step_log(events: DataFrame, time: str, step: str, loss: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mean loss per time window, late rows accepted up to the watermark."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, window).alias("w")).agg(F.count(step).alias("steps"), F.avg(loss).alias("loss")).select(F.col("w.start").alias("start"), "steps", "loss")


def run_available(spark: SparkSession, stream: DataFrame, name: str, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, resuming from ``checkpoint``, and read its result."""
    query = stream.writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""The page plans over a stream: a file arrives whole, so every page is complete in its batch and no state is kept between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Documents (Parquet files that are added to a folder)."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def pdf_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """PDF files that are added to a folder: path, content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(path).select("path", "content")


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """``plan`` on each batch, appended to Parquet; a batch that is repeated after a failure replaces its own folder, so results stand once."""

    def batch(rows: DataFrame, number: int) -> None:
        plan(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts of events by type and window, with a watermark for late ones (for monitoring a stream of conversions)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

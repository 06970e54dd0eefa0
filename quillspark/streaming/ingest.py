"""Incremental ingest: pages as a stream, late and repeated deliveries settled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import word_count


def read_page_stream(spark: SparkSession, directory: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def deduplicate(pages: DataFrame, delay: str = "30 days") -> DataFrame:
    """First delivery of a page text within the delay; state older than it is dropped."""
    keyed = pages.withColumn("content_key", F.sha2(F.coalesce("content", F.lit("")), 256))
    return keyed.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["source", "page_number", "content_key"]).drop("content_key")


def loads_per_window(pages: DataFrame, delay: str = "30 days", width: str = "1 day") -> DataFrame:
    """Pages and words per window of load time, late rows within the delay included."""
    return pages.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", width)).agg(F.count("*").alias("pages"), F.sum(word_count(F.col("content"))).alias("words")).select(F.col("window.start").alias("window_start"), "pages", "words")


def write_pages(pages: DataFrame, directory: str, checkpoint: str):
    return pages.writeStream.format("parquet").option("path", directory).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

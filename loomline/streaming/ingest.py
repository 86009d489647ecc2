"""Chapters from a folder as files arrive: each run takes what is new and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.segments import chapters_from_texts


def chapter_stream(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.readStream.option("pathGlobFilter", "*.txt").schema("value string").text(folder, wholetext=True)
    return chapters_from_texts(texts.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")))


def ingest_available(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Appends the chapters of files that no earlier run with this checkpoint has seen, and ends."""
    query = chapter_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

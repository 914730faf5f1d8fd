"""Variant files as a stream: each new file is filtered once, whenever it arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def call_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows (chrom, pos, ref, alt, qual, line) of the variant files in ``folder``."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = text.filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    f = lambda i: F.get("f", F.lit(i))
    return rows.select(f(0).alias("chrom"), f(1).try_cast("long").alias("pos"), f(3).alias("ref"), f(4).alias("alt"), f(5).try_cast("double").alias("qual"), F.col("value").alias("line"))


def filter_stream(calls: DataFrame, condition: str | Column, path: str, checkpoint: str):
    """Write what fulfils ``condition`` to Parquet under ``path``, all that is there now, then end."""
    return calls.filter(condition).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

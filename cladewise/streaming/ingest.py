"""Reads that arrive as a stream, added up by (cell, SNV). An extension: the batch engine has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def additive_sink(path: str):
    """foreachBatch target: each epoch's sums go to a folder of their own, and a repeated epoch replaces its folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("cell_id", "snv_id").agg(F.sum("var").alias("var"), F.sum("total").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(additive_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).groupBy("cell_id", "snv_id").agg(F.sum("var").alias("var"), F.sum("total").alias("total"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))

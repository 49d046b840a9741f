"""Catalog entries and snapshots that arrive as files, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_entries(spark: SparkSession, folder: str, schema: StructType, watermark: str | None = None, delay: str = "1 day") -> DataFrame:
    """New Parquet files of a folder as a stream; with a watermark column, later events than the delay are dropped by stateful steps."""
    df = spark.readStream.schema(schema).parquet(folder)
    return df.withWatermark(watermark, delay) if watermark else df


def keep_latest(entries: DataFrame, key: str, by: str, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Maintain target (a folder of two generations) with the latest row of each key that the stream has brought.

    Each batch is merged with the generation before it and written as a new one, so a batch run again
    after a failure gives the same result.
    """
    from editrail.runtime import latest

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/gen={(batch_id - 1) % 2}").unionByName(batch)
        latest(rows, [key], [by]).write.mode("overwrite").parquet(f"{target}/gen={batch_id % 2}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes_per_window(entries: DataFrame, at: str, window: str, kind: str) -> DataFrame:
    """Counts of arrivals by kind and event-time window; late rows count until the watermark passes."""
    from pyspark.sql import functions as F

    return entries.groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))

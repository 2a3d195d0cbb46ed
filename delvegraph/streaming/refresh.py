"""Incremental index refresh and windowed recurrence, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh_index(stream: DataFrame, index_path: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame], key: str = "content_hash"):
    """Append derived rows of new content only: each micro-batch is reduced to keys the
    index lacks, so a batch that runs twice adds nothing the second time."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if spark._jvm.org.apache.hadoop.fs.Path(index_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(index_path)):
            new = new.join(spark.read.parquet(index_path).select(key).distinct(), key, "left_anti")
        derive(new).write.mode("append").parquet(index_path)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of tumbling event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)

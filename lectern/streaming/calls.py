"""Streaming forms: the hourly call counts with late events, and the URL cache as a keyed merge of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ingest import cache_upserted


def hourly_calls(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(period, task_name, calls) of a stream (ts, event_type); events later than the watermark are left out, null times too."""
    timed = events.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = timed.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("task_name")).agg(F.count(F.lit(1)).alias("calls"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:00").alias("period"), "task_name", "calls")


def cache_merger(path: str):
    """A ``foreachBatch`` function that merges pages into the cache at ``path``; versions alternate, so readers never see half of one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{(number - 1) % 2}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{before}/_SUCCESS")
        # Only a version that was never written counts as empty; a read that fails stops the stream and leaves the cache as it is.
        known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        old = spark.read.parquet(before) if known else batch.limit(0)
        cache_upserted(old, batch.dropDuplicates(["url_hash"])).write.mode("overwrite").parquet(f"{path}/v{number % 2}")

    return merge

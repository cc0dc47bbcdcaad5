"""Streams: augmentation record by record, memoised calls and index maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narrascope.functions.text import cache_key


def json_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New JSON lines files, at most ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def augment(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write what ``step`` makes of every micro-batch; a restart goes on after the last finished one, and a repeated one replaces its rows."""

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_text(stream: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of every text within the delay, by the hash of the stripped text."""
    return stream.withColumn("key", cache_key(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def maintain_index(stream: DataFrame, index: str, checkpoint: str, key: str = "vec_id") -> StreamingQuery:
    """Append new vectors to the index table, leaving out ids that it has."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = spark.read.parquet(index).select(key).distinct()
        batch.dropDuplicates([key]).join(have, key, "left_anti").select(*batch.columns).write.mode("append").parquet(index)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of event types in tumbling windows; an extra beyond the domain's own batch operators."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

"""Panels from a stream of events: windowed means with a watermark, ready for the batch operators.

An extension: the batch operators need complete calendars, and a stream gives closed windows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_means(events: DataFrame, entity: str, time: str, value: str, step: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """(entity, start, level, n) of closed windows; events later than ``late`` behind the newest are left out."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.col(entity).alias("entity"), F.window("_t", step).alias("w")).agg(F.avg(value).alias("level"), F.count("*").alias("n")).select("entity", F.col("w.start").alias("start"), "level", "n")


def append_panel(means: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends closed windows to a Parquet panel; a restart goes on where the checkpoint stands."""
    writer = means.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

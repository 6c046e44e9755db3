"""The batch transforms on streams: one function for both, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """By window and kind of event: rows, sum of values. Works on a table and on a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("window_us"), "event_type", "n", "total")


def sliding_figures(events: DataFrame, key: str, width: str = "2 days", step: str = "1 day") -> DataFrame:
    """By overlapping window and key: rows, sum, smallest and largest value. Works on a table and on a stream; on a stream a window's row is updated until the watermark has passed it."""
    by = events.groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return by.select(F.unix_micros("w.start").alias("window_us"), key, "n", "total", "least", "most")


def idle_sessions(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """By user: sessions that end after so long without an event."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def event_stream(spark: SparkSession, folder: str, late: str = "1 hour", per_trigger: int = 1) -> DataFrame:
    """A folder's event files as a stream with a timestamp and a watermark."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drained(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream of updated rows over what is there; returns the last row of each key, from Parquet in the folder (the driver holds none of them)."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")  # a batch that is tried again replaces itself

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")

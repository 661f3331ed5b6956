"""Streaming forms of the take and counter operators; each takes a streaming DataFrame of events and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeweave.session import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they land (T01); ts as a timestamp in the session's zone, which the library keeps at UTC."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) by tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(user_id, event_type, start, n): takes of a key not further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", "event_type", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "event_type", F.unix_millis("w.start").alias("start_ms"), "n")


def last_takes(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(user_id, event_type, start_ms, event_id): the last event of each take cluster, ties by the greater id."""
    g = events.withWatermark("ts", late).groupBy("user_id", "event_type", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return g.select("user_id", "event_type", F.unix_millis("w.start").alias("start_ms"), "x.event_id")


def distinct_events(events: DataFrame) -> DataFrame:
    """Events once each over the whole stream (T05), however late and in however many batches they come.

    There is no watermark, so the state keeps every event's ids; it lies in the shared folder.
    """
    return events.select("event_id", "user_id").dropDuplicates(["event_id", "user_id"])


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote: the sink and its state lie in the shared folder.

    Complete-mode results are written per batch and the last one read.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    if mode == "complete":
        sink = stream.writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out))
    else:
        sink = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state)
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

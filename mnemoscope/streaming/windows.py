"""Event-time windows and sinks; each works on a stream and, for checking, on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by kind in tumbling or sliding windows; late rows are dropped behind the watermark."""
    own = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(own.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total")
    )


def presence(events: DataFrame, ttl: str, late: str = "1 hour") -> DataFrame:
    """Sessions of heartbeats by user: a session ends when the time to live passes."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n_beats")).select("user_id", F.col("w.start").alias("joined_at"), F.col("w.end").alias("expires_at"), "n_beats")


def enqueued(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """Idempotent enqueueing: the first job of each (queue_id, job_key) while the watermark holds."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["queue_id", "job_key"])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there as JSON lines and stop; the checkpoint is the cursor, so delivery goes on where it ended."""
    writer = stream.writeStream.format("json").outputMode(mode)
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def envelopes(batch: DataFrame, size: int = 500) -> DataFrame:
    """JSON texts ``{"records":[...]}`` of a batch, up to ``size`` rows of one task in each: bodies for an HTTP sink."""
    if batch.isStreaming:
        raise ValueError("envelopes are made of a batch, inside forward's callback")
    # Rows of a task are numbered as they come, so no row moves to another machine for its place.
    place = F.shiftrightunsigned(F.monotonically_increasing_id(), 33).alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")
    rows = batch.select(*place, F.struct(*batch.columns).alias("r")).select("part", F.floor(F.col("nth") / size).alias("block"), "nth", "r")
    own = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.to_json("r").alias("r")))), lambda x: x["r"])
    return rows.groupBy("part", "block").agg(F.concat(F.lit('{"records":['), F.array_join(own, ","), F.lit("]}")).alias("body")).select("body")


def forward(stream: DataFrame, send, checkpoint: str) -> StreamingQuery:
    """Hand each batch to ``send(batch, number)``, at least once: an HTTP, socket or queue sink."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

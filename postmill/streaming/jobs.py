"""Streaming jobs (K1, K2).

K1 scores responses as they arrive (file source -> stream-static join with the
task table -> reward -> append sink, checkpointed, stateless). K2 averages
rewards per event-time window and run with a watermark for late data (append
mode: a window is emitted once the watermark passes its end).

The transformations are plain functions of DataFrames, so the same code runs
on a streaming DataFrame and on its batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.answer import score_answers

RESPONSE_SCHEMA = "task_id bigint, response string"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def score_responses(responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attach the task (stream-static equi-join on task_id) and score."""
    j = responses.join(tasks.select("task_id", "nums", "target"), "task_id")
    s = score_answers(j, "response", "nums", "target")
    return s.select("task_id", "response", "score")


def reward_windows(events: DataFrame, window: str = "1 hour", watermark: str | None = "10 minutes",
                   run: str = "event_type", reward: str = "value") -> DataFrame:
    """Mean reward and count per (event-time window, run). With a watermark,
    ``ts`` (TIMESTAMP_NTZ in the driver tables) is cast to TIMESTAMP, which
    withWatermark requires; run streams with the session time zone at UTC."""
    e = events
    if watermark:
        # withWatermark rejects TIMESTAMP_NTZ; the batch form windows the NTZ
        # values directly and does not depend on the session time zone.
        e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    agg = e.groupBy(F.window("ts", window).alias("w"), F.col(run).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean_reward"))
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run", "n",
                      "mean_reward")


def start_scoring(spark: SparkSession, responses_dir: str, tasks: DataFrame, out_dir: str, checkpoint: str,
                  fmt: str = "json", available_now: bool = True, max_files_per_trigger: int | None = None):
    """K1: file stream of JSON-lines responses -> scored submission rows,
    appended to ``out_dir``. Exactly-once through the checkpoint."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(responses_dir)
    w = (score_responses(stream, tasks).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_reward_windows(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str,
                         window: str = "1 hour", watermark: str = "10 minutes", available_now: bool = True):
    """K2: file stream of events -> windowed mean reward per run, append mode."""
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(events_dir)
    w = (reward_windows(stream, window, watermark).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

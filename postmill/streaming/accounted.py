"""Event-time windows that account for every row (K2).

A watermark makes a stream drop rows of windows that are closed already, without a trace.
Here they are kept: each micro-batch is split by the watermark that its predecessors set.
Rows of open windows go into partial sums, late rows to a reject side of their own. Every
row that came in is in a closed window, in an open one, or rejected.

What a micro-batch writes lies in a folder named by its number and is overwritten if the
batch runs again, and it depends only on batches before it; so a stream that is stopped
or fails anywhere goes on from its checkpoint without a row lost or counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIALS = "window_start timestamp_ntz, window_end timestamp_ntz, run string, n bigint, total double, batch bigint"
MARKS = "max_ts timestamp_ntz, n bigint, batch bigint"


class AccountedWindows:
    """Count and mean of ``value`` per window and ``run`` over rows with a time ``ts`` (TIMESTAMP_NTZ).

    ``folder`` is shared by driver and executors and holds the partial sums, the rejected
    rows, the watermarks and the checkpoint. A row is late if its window ended at or before
    the latest time of all earlier batches less ``delay``; a row without a time belongs to
    no window and is rejected, too. Other columns, also unknown ones, stay with rejected
    rows. A null run is a run of its own, a null value counts and adds nothing to the mean.
    """

    def __init__(self, spark: SparkSession, folder: str, window: str = "1 hour", delay: str = "10 minutes", run: str = "event_type",
                 value: str = "value"):
        self.spark, self.folder, self.window, self.delay, self.run, self.value = spark, folder, window, delay, run, value

    def feed(self, source: DataFrame, available_now: bool = True):
        """Start the stream over ``source``; with ``available_now`` it ends when all has been read."""
        w = source.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()

    def _take(self, batch: DataFrame, number: int) -> None:
        mark = self.watermark(before=number)
        batch = batch.persist()  # lost blocks are read again from the source
        try:
            timed = batch.where(F.col("ts").isNotNull()).withColumn("_w", F.window("ts", self.window))
            late = F.lit(False) if mark is None else F.col("_w.end") <= F.lit(mark.isoformat(sep=" ")).cast("timestamp_ntz")
            sums = timed.where(~late).groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), F.col(self.run).alias("run"))
            self._write(sums.agg(F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total")), "partials", number)
            rejected = (timed.where(late).withColumn("window_start", F.col("_w.start")).drop("_w").withColumn("reject_reason", F.lit("late"))
                        .unionByName(batch.where(F.col("ts").isNull()).withColumn("window_start", F.lit(None).cast("timestamp_ntz"))
                                     .withColumn("reject_reason", F.lit("no_time"))))
            self._write(rejected, "rejected", number)
            self._write(batch.agg(F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n")), "marks", number)
        finally:
            batch.unpersist()

    def _write(self, df: DataFrame, part: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{part}/batch={number}")

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def watermark(self, before: int | None = None):
        """The latest time seen (by batches before ``before``) less the delay; None before the first."""
        if before == 0:
            return None
        marks = self._read("marks", MARKS)
        marks = marks if before is None else marks.where(F.col("batch") < before)
        return marks.agg((F.max("max_ts") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first()["w"]

    def windows(self) -> DataFrame:
        """(window_start, run, n, mean_reward, closed) of what has come in on time."""
        mark = self.watermark()
        end = F.lit(None if mark is None else mark.isoformat(sep=" ")).cast("timestamp_ntz")
        sums = self._read("partials", PARTIALS).groupBy("window_start", "window_end", "run").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return sums.select("window_start", "run", "n", (F.col("total") / F.col("n")).alias("mean_reward"), (F.col("window_end") <= end).alias("closed"))

    def rejected(self) -> DataFrame:
        """Late rows and rows without a time, with ``window_start`` and ``reject_reason``."""
        return self.spark.read.parquet(f"{self.folder}/rejected")

    def rows_in(self) -> int:
        """Rows that all batches have brought."""
        return self._read("marks", MARKS).agg(F.sum("n")).first()[0] or 0

"""Sinks and streams that are read back."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from postmill.sources import io as IO
from postmill.sources.outcomes import read_outcomes, write_outcomes
from postmill.sources.scratch import RunFolder, shared_root
from postmill.streaming.accounted import AccountedWindows


def _rows(spark, n=40):
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 4 == 1, "short").when(F.col("id") % 4 == 2, "odd name").alias("reject_reason"))
    return df.repartition(3)


def test_outcomes_are_written_and_counted_in_one_pass(spark, tmpdir_path):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    df = _rows(spark)
    seen = write_outcomes(df.mapInArrow(count, df.schema), tmpdir_path + "/o", ["short", "never"])
    assert seen == {"kept": 20, "short": 10, "never": 0, "other": 10} and calls.value == 40
    back = read_outcomes(spark, tmpdir_path + "/o", "id bigint")
    assert sorted(r.id for r in back.collect()) == list(range(40))
    assert {r.outcome: r["count"] for r in back.groupBy("outcome").count().collect()} == {"kept": 20, "short": 10, "odd name": 10}
    one = read_outcomes(spark, tmpdir_path + "/o", "id bigint", ["short"])
    assert {r.id % 4 for r in one.collect()} == {1}
    assert "PartitionFilters: [isnotnull(outcome" in one._jdf.queryExecution().executedPlan().toString()


def test_outcomes_of_nothing_and_clashes(spark, tmpdir_path):
    df = _rows(spark).where("id < 0")
    assert write_outcomes(df, tmpdir_path + "/o", ["short"]) == {"kept": 0, "short": 0}
    assert read_outcomes(spark, tmpdir_path + "/o", "id bigint").count() == 0
    with pytest.raises(ValueError):
        write_outcomes(df.withColumn("outcome", F.lit(1)), tmpdir_path + "/p")


def test_split_reads_are_pruned(spark, tmpdir_path):
    spark.createDataFrame([("a", "train"), ("b", "test")], "q string, split string").write.partitionBy("split").parquet(tmpdir_path + "/c")
    plan = IO.read_split(spark, tmpdir_path + "/c", "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


class _Session:
    """As much of a session as a folder's name needs."""

    def __init__(self, master, folder):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" else default


def test_shared_root_is_the_sessions_checkpoint_folder():
    assert shared_root(_Session("spark://x:7077", "/shared/dir/")) == "/shared/dir"
    assert RunFolder(_Session("local[2]", "/shared/dir"), "x").at("y").startswith("/shared/dir/x-")
    assert shared_root(_Session("local[2]", None))
    with pytest.raises(ValueError):
        shared_root(_Session("spark://x:7077", None))  # never a machine's own folder on a cluster


SCHEMA = "ts timestamp_ntz, event_type string, value double, note string"


def _at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def _feed(spark, job, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)
    job.feed(spark.readStream.schema(SCHEMA).json(folder)).awaitTermination()


def test_every_row_is_closed_open_or_rejected(spark, tmpdir_path):
    src, job = tmpdir_path + "/in", AccountedWindows(spark, tmpdir_path + "/job")
    parts = [[(_at(5), "a", 1.0, "x"), (_at(50), "a", 3.0, "x"), (_at(125), None, 4.0, "x")],
             [(_at(55), "a", 9.0, "late"), (_at(65), "b", 2.0, "on time"), (None, "a", 1.0, "no time")],  # the mark is 115: the first hour is closed
             [(_at(200), "a", None, "x"), (_at(200), "a", 5.0, "x"), (_at(61), "b", 7.0, "on time")],
             [(_at(119), "b", 7.0, "late"), (_at(180), "a", 7.0, "on time")]]
    for rows in parts:
        _feed(spark, job, src, rows)
    job.feed(spark.readStream.schema(SCHEMA).json(src)).awaitTermination()  # nothing new
    got = {(r.window_start, r.run): (r.n, r.mean_reward, r.closed) for r in job.windows().collect()}
    assert got == {(_at(0), "a"): (2, 2.0, True), (_at(60), "b"): (2, 4.5, True), (_at(120), None): (1, 4.0, True), (_at(180), "a"): (3, 4.0, False)}
    lost = job.rejected().collect()
    assert sorted((r.note, r.reject_reason) for r in lost) == [("late", "late"), ("late", "late"), ("no time", "no_time")]
    assert job.rows_in() == sum(n for n, _, _ in got.values()) + len(lost) == sum(map(len, parts))


def test_a_batch_that_runs_again_counts_once(spark, tmpdir_path):
    """A stream that failed after writing a batch, but before its commit, runs it again."""
    src, job = tmpdir_path + "/in", AccountedWindows(spark, tmpdir_path + "/job")
    _feed(spark, job, src, [(_at(5), "a", 1.0, "x"), (_at(300), "a", 3.0, "x")])
    _feed(spark, job, src, [(_at(6), "a", 1.0, "late"), (_at(310), "a", 3.0, "x")])
    before = sorted(map(tuple, job.windows().collect())), job.rejected().count(), job.rows_in()
    for name in ("1", ".1.crc"):
        os.remove(f"{tmpdir_path}/job/checkpoint/commits/{name}")  # the second batch was not committed
    job.feed(spark.readStream.schema(SCHEMA).json(src)).awaitTermination()
    assert (sorted(map(tuple, job.windows().collect())), job.rejected().count(), job.rows_in()) == before
    assert before[1:] == (1, 4)


def test_prompt_lists_keep_their_order(spark, tmpdir_path):
    spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None), (4, ["c"])], "k long, prompts array<string>").write.json(tmpdir_path + "/p")
    got = IO.read_prompt_lists(spark, tmpdir_path + "/p", key="k bigint").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "b"), (1, 1, "a"), (4, 0, "c")]

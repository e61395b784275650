"""Skew-safe prefix sums and global positions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators.sample import epoch_batches, seeded_key
from postmill.plans.scan import global_index, running_sum


def test_running_sum_matches_window_with_small_chunks(spark):
    rnd = random.Random(1)
    rows = [(g, o, rnd.randint(0, 9)) for g in range(3) for o in range(rnd.randint(1, 40))]
    rows += [(9, o, 1) for o in range(500)]                      # one hot group
    df = spark.createDataFrame(rows, "g int, o int, v int")
    got = running_sum(df, ["g"], "o", "v", "rs", chunk=7)
    want = df.withColumn("rs", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_global_index_is_a_dense_permutation(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    out = global_index(df, seeded_key(42, "k"), "k", bits=8)
    idx = sorted(r.idx for r in out.collect())
    assert idx == list(range(3000))
    want = [r.k for r in df.orderBy(seeded_key(42, "k"), "k").collect()]
    assert [r.k for r in out.orderBy("idx").collect()] == want


def test_epoch_batches_partition_independent(spark):
    df = spark.range(500).withColumnRenamed("id", "event_id")
    a = epoch_batches(df, "event_id", 2, 4, 42).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = epoch_batches(df.repartition(7), "event_id", 2, 4, 42).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(a) == sorted(b)


def test_first_last_and_sample_do_not_depend_on_size_or_nulls(spark):
    from postmill.operators.sample import first_n, last_n, seeded_sample
    for rows in (7, 10, 4000):
        df = spark.createDataFrame([(None, "x")] + [(f"k{i:05d}", "x") for i in range(1, rows)], "k string, v string").repartition(5)
        assert [r.k for r in first_n(df, 1, "k").collect()] == ["k00001"]
        assert [r.k for r in last_n(df, 2, "k").collect()] == [f"k{rows - 1:05d}", f"k{rows - 2:05d}"]
        assert len(seeded_sample(df, 5, 3, "k").collect()) == 5
    few = spark.createDataFrame([(None,), (1,)], "k long")
    assert [r.k for r in first_n(few, 5, "k").collect()] == [1, None]

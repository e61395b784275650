"""Token arrays (F1-F6) and loss statistics."""

import math

from pyspark.sql import functions as F

from postmill.operators import losses as LS
from postmill.operators import tokens as T
from postmill.plans import inputs as I
from tests.conftest import SF_SMALL


def test_pad_truncate_both_sides(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    r_ids, r_mask = T.pad_truncate("ids", 4, 0, "right")
    l_ids, l_mask = T.pad_truncate("ids", 4, 0, "left")
    got = df.select(r_ids.alias("a"), r_mask.alias("b"), l_ids.alias("c"), l_mask.alias("d")).collect()
    assert got[0] == ([5, 6, 7, 0], [1, 1, 1, 0], [0, 5, 6, 7], [0, 1, 1, 1])
    assert got[1] == ([1, 2, 3, 4], [1, 1, 1, 1], [1, 2, 3, 4], [1, 1, 1, 1])


def test_span_labels_last_and_clamped(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 0, 0, 0], 5, [(0, 2), (3, 5)]),
                                ([1, 2, 3, 4], 4, [(1, 9)])],
                               "ids array<int>, n int, spans array<struct<start:int,end:int>>")
    lab, mask = T.span_labels("ids", "n", "spans", 8, keep="last")
    r = df.select(lab.alias("l"), mask.alias("m")).collect()
    assert r[0].l == [-100, -100, -100, 4, 5, 0, -100, -100]      # span (3,5) plus one eos
    assert r[0].m == [1, 1, 1, 1, 1, 1, 0, 0]                      # mask[end] set
    lab4, mask4 = T.span_labels("ids", "n", "spans", 4, keep="all")
    r = df.select(lab4.alias("l"), mask4.alias("m")).collect()[1]
    assert r.l == [-100, 2, 3, 4] and r.m == [1, 1, 1, 1]          # clamped end: no extra token


def test_response_mask_and_sums(spark):
    df = spark.createDataFrame([([1, 1, 1, 1, 0], [-1.0, -2.0, -3.0, -4.0], 1)], "m array<int>, lp array<double>, pl int")
    rm = T.response_mask("m", "pl")
    r = df.select(rm.alias("rm"), LS.masked_sum("lp", rm).alias("s"), LS.masked_mean("lp", rm).alias("a")).first()
    assert r.rm == [False, True, True, False]
    assert r.s == -5.0 and r.a == -2.5


def test_leave_one_out_advantages_sum_to_zero(spark):
    r = LS.leave_one_out(I.rollouts(spark, SF_SMALL))
    sums = r.groupBy("prompt_id").agg(F.sum("advantage").alias("s"), F.first("k").alias("k")).collect()
    assert all(abs(x.s) < 1e-9 for x in sums if x.k > 1)


def test_preference_stats_small(spark):
    df = spark.createDataFrame([(0, -1.0, -2.0, -1.5, -1.5)], "b int, chosen_lp double, rejected_lp double, "
                               "chosen_ref_lp double, rejected_ref_lp double")
    r = LS.preference_stats(df, "b").first()
    d = (-1.0 + 1.5) - (-2.0 + 1.5)
    assert math.isclose(r.loss, math.log1p(math.exp(-0.1 * d)))
    assert r.reward_acc == 1.0 and math.isclose(r.reward_diff, d)


def test_log_sigmoid_stable(spark):
    r = spark.range(1).select(LS.log_sigmoid(F.lit(-800.0)).alias("a"), LS.log_sigmoid(F.lit(800.0)).alias("b")).first()
    assert r.a == -800.0 and r.b == 0.0


def test_response_mask_of_left_padded_rows(spark):
    rows = [([1, 1, 1, 1, 0, 0], 2, 2), ([1, 1, 1, 1, 1, 1], 3, 0), ([1, 0, 0, 0, 0, 0], 1, 5), ([0] * 6, 0, 6)]
    df = spark.createDataFrame([(m, p, n, [-1.0 * k for k in range(1, 6)]) for m, p, n in rows], "m array<int>, p int, n int, lp array<double>")
    flipped = df.withColumn("lm", F.reverse("m")).withColumn("ll", T.left_padded("lp", F.least("n", F.lit(5)), 99.0))
    got = flipped.select(T.response_mask("m", "p").alias("right"), T.response_mask("lm", "p").alias("left"), T.first_real("lm").alias("at"),
                         T.response_mask("lm", "p", prompt_offset=0).alias("formula"), T.response_mask("lm", "p", prompt_offset=F.col("n")).alias("given"),
                         LS.masked_sum("lp", T.response_mask("m", "p")).alias("a"), LS.masked_sum("ll", T.response_mask("lm", "p")).alias("b")).collect()
    for (m, p, n), r in zip(rows, got):
        assert sum(r.right) == sum(r.left) == max(0, sum(m) - 1 - p) and r.a == r.b
        assert r.at == (n if any(m) else -1)
        assert r.left == r.given or not any(m)
    assert got[0].formula == [False, False, True, True, True]  # two prompt tokens too many

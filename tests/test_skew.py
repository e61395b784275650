"""A third of all rows on one key must give the same results as the plain
definition (hot keys are combined map-side or split, never special-cased)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import countdown as CD
from postmill.operators import losses as LS
from postmill.operators import preference as P
from tests.test_countdown import _brute


def test_search_with_hot_task(spark):
    rnd = random.Random(5)
    rows = [(i, [15, 5, 75, 90], 21) for i in range(300)]
    rows += [(300 + i, [rnd.randint(1, 20) for _ in range(3)], rnd.randint(0, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "task_id long, nums array<int>, target int")
    got = {r.task_id: r.answer_raw for r in CD.solve(df, partitions=5).collect()}
    assert len(got) == 900
    memo = {}
    for tid, nums, target in rows:
        k = (tuple(nums), target)
        if k not in memo:
            memo[k] = _brute(nums, target)
        assert got[tid] == memo[k]


def test_pairs_and_leave_one_out_with_hot_prompt(spark):
    rnd = random.Random(9)
    rows = [(0, t, f"text {t}", float(rnd.randint(0, 10))) for t in range(3000)]
    rows += [(c, t, f"t{c}-{t}", float(rnd.randint(0, 10))) for c in range(1, 200) for t in range(15)]
    cands = spark.createDataFrame(rows, "conv_id long, turn long, text string, score double")
    pairs = {r.conv_id: r for r in P.best_worst_pairs(cands).collect()}
    hot = [r for r in rows if r[0] == 0]
    best = max(hot, key=lambda r: (r[3], -r[1]))
    worst = min(hot, key=lambda r: (r[3], r[1]))
    assert (pairs[0].chosen_turn, pairs[0].rejected_turn) == (best[1], worst[1])

    samples = cands.select(F.col("conv_id").alias("prompt_id"), F.col("score").alias("reward"), "turn")
    got = LS.leave_one_out(samples)
    w = Window.partitionBy("prompt_id")
    want = samples.withColumn("k", F.count(F.lit(1)).over(w)).withColumn(
        "advantage", F.col("reward") - (F.sum("reward").over(w) - F.col("reward")) / (F.col("k") - 1))
    a = {(r.prompt_id, r.turn): round(r.advantage, 9) for r in got.collect()}
    b = {(r.prompt_id, r.turn): round(r.advantage, 9) for r in want.collect()}
    assert a == b

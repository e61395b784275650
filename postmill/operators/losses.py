"""Sequence log-prob and loss statistics as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def masked_sum(values, mask) -> Column:
    """Σ values over a boolean mask (G1)."""
    return F.aggregate(F.zip_with(_c(values), _c(mask), lambda v, m: F.when(m, v).otherwise(F.lit(0.0))),
                       F.lit(0.0), lambda a, x: a + x)


def mask_count(mask) -> Column:
    return F.aggregate(_c(mask), F.lit(0), lambda a, m: a + F.when(m, 1).otherwise(0))


def masked_mean(values, mask) -> Column:
    """G1 / max(1, mask count)."""
    return masked_sum(values, mask) / F.greatest(F.lit(1), mask_count(mask))


def log_sigmoid(x) -> Column:
    """Numerically stable log(sigmoid(x))."""
    x = _c(x)
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def preference_stats(pairs: DataFrame, group: str, beta: float = K.DPO_BETA,
                     pc: str = "chosen_lp", pr: str = "rejected_lp",
                     rc: str = "chosen_ref_lp", rr: str = "rejected_ref_lp") -> DataFrame:
    """Preference-loss statistics per ``group`` (G3): ratios are policy minus
    reference; loss = mean(-logsigmoid(beta * (cr - rr))), accuracy, margin,
    mean chosen / rejected ratios."""
    cr = F.col(pc) - F.col(rc)
    rjr = F.col(pr) - F.col(rr)
    d = cr - rjr
    return pairs.groupBy(group).agg(
        F.avg(-log_sigmoid(F.lit(beta) * d)).alias("loss"),
        F.avg(F.when(cr > rjr, 1.0).otherwise(0.0)).alias("reward_acc"),
        F.avg(d).alias("reward_diff"),
        F.avg(cr).alias("chosen_ratio"),
        F.avg(rjr).alias("rejected_ratio"),
        F.count(F.lit(1)).alias("n_pairs"))


def bradley_terry(pairs: DataFrame, group: str, chosen: str = "chosen_reward",
                  rejected: str = "rejected_reward") -> DataFrame:
    """Mean -logsigmoid(chosen - rejected) per group."""
    return pairs.groupBy(group).agg(F.avg(-log_sigmoid(F.col(chosen) - F.col(rejected))).alias("loss"),
                                    F.count(F.lit(1)).alias("n_pairs"))


def leave_one_out(samples: DataFrame, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Leave-one-out baseline and advantage per sample (G5): baseline =
    (Σr - r)/(k-1) over the prompt's samples, advantage = r - baseline;
    k = 1 gives NULL. Prompt totals are a grouped aggregate joined back, so a
    prompt with very many samples is never held by one task."""
    tot = samples.groupBy(prompt).agg(F.sum(reward).alias("_sum"), F.count(F.lit(1)).alias("k"))
    out = samples.join(tot, prompt)
    base = F.try_divide(F.col("_sum") - F.col(reward), (F.col("k") - 1).cast("double"))
    return out.withColumn("baseline", base).withColumn("advantage", F.col(reward) - F.col("baseline")).drop("_sum")


def loo_prompts(samples: DataFrame, prompt: str = "prompt_id", reward: str = "reward", lp: str = "seq_lp",
                chunk: str = "chunk") -> DataFrame:
    """Per prompt in one pass (G5): ``k``, the leave-one-out loss -mean(advantage *
    log-prob), and the sum and mean of its generation chunks' mean rewards. With S the
    reward sum, advantage = (k r - S) / (k - 1), so the loss needs only sums; k = 1
    gives NULL."""
    per = samples.groupBy(prompt, chunk).agg(
        F.count(F.lit(1)).alias("_k"), F.sum(reward).alias("_r"), F.sum(lp).alias("_lp"),
        F.sum(F.col(reward) * F.col(lp)).alias("_rlp"), F.avg(reward).alias("_cm"))
    t = per.groupBy(prompt).agg(F.sum("_k").alias("k"), F.sum("_r").alias("_s"), F.sum("_lp").alias("_lp"),
                                F.sum("_rlp").alias("_rlp"), F.sum("_cm").alias("reward_chunk_sum"),
                                F.avg("_cm").alias("reward_chunk_mean"))
    loss = -F.try_divide(F.col("k") * F.col("_rlp") - F.col("_s") * F.col("_lp"), (F.col("k") * (F.col("k") - 1)).cast("double"))
    return t.select(prompt, "k", loss.alias("loss"), "reward_chunk_sum", "reward_chunk_mean")

"""Evaluation aggregates and training-log rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import constants as K


def score_summary(df: DataFrame, score: str = "score", group: list[str] | None = None) -> DataFrame:
    """Mean score plus a count per score class."""
    s = F.col(score)
    return df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"),
        F.count_if(s == 0).alias("n_zero"), F.count_if(s == K.FORMAT_SCORE).alias("n_format"),
        F.count_if(s == K.CORRECT_SCORE).alias("n_correct"))


def win_rate(scores: DataFrame, baseline: str, run: str = "run", item: str = "item", score: str = "score") -> DataFrame:
    """Win rate of every run against one baseline run over shared items (G9):
    1 for a win, 0.5 for a tie, 0 for a loss. One equi-join per item with the
    baseline's row, not all run pairs."""
    base = scores.where(F.col(run) == baseline).select(item, F.col(score).alias("_b"))
    j = scores.where(F.col(run) != baseline).join(base, item)
    pts = F.when(F.col(score) > F.col("_b"), 1.0).when(F.col(score) == F.col("_b"), 0.5).otherwise(0.0)
    return j.groupBy(run).agg(F.count(F.lit(1)).alias("n_items"), F.avg(pts).alias("win_rate"))


def rank_runs(means: DataFrame, run: str = "run", score: str = "mean_score") -> DataFrame:
    """Leaderboard rank over per-run means (G10). The input has one row per
    run (already aggregated), so the global window is over a run-sized table."""
    return means.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col(score).desc())))


def _windows(steps: DataFrame, aggs: list, log_steps: int, run: str | None, step: str, first: int) -> DataFrame:
    """One row per (run, log window): ``aggs``, the recorded steps ``_n`` and the last one,
    from one aggregate that combines map-side."""
    d = steps.withColumn("log_window", F.floor((F.col(step) - first) / log_steps).cast("bigint"))
    return d.groupBy(*([run] if run else []), "log_window").agg(F.count(F.lit(1)).alias("_n"), F.max(step).alias("_last"), *aggs)


def _full(log_steps: int, first: int, end) -> Column:
    """Whether the run went on past the window's end. Steps may be missing, so a window is
    judged by its run's last step, not by its count; only a run's true last window can be
    partial."""
    return (F.col("log_window") + 1) * log_steps + (first - 1) <= end


def rollup_mean(steps: DataFrame, metric: str, log_steps: int = K.LOG_STEPS, scale: float = 1.0,
                run: str = "run") -> DataFrame:
    """Logged value of each run every ``log_steps`` steps: the mean of metric * scale
    over the window's recorded steps; a run's partial last window is not logged (G7a;
    G7c with ``scale = 1 / accumulation``)."""
    per = _windows(steps, [F.sum(F.col(metric) * F.lit(scale)).alias("_sum")], log_steps, run, "step", 1)
    per = per.withColumn("_end", F.max("_last").over(Window.partitionBy(run)))  # a row a log window
    return per.where(_full(log_steps, 1, F.col("_end"))).select(
        run, "log_window", ((F.col("log_window") + 1) * log_steps).alias("step"), (F.col("_sum") / F.col("_n")).alias(f"avg_{metric}"))


def rollup_preference(steps: DataFrame, log_steps: int = K.LOG_STEPS, run: str = "run") -> DataFrame:
    """Preference-training log of each run (G7b). loss / reward_acc / reward_diff reset
    each window; the two ratio sums never reset in the reference, so they are
    cumulative sums / log_steps (kept as-is, plus the true window means). A run's
    partial last window logs ``loss`` only, averaged over its own steps (``is_final``).
    The last step and the cumulative sums both come from windows over the rolled-up
    rows, one a log window of a run, so the steps are read once."""
    sums = [F.sum(c).alias(a) for c, a in (("loss", "_loss"), ("reward_acc", "_acc"), ("reward_diff", "_diff"),
                                           ("chosen_ratio", "_cr"), ("rejected_ratio", "_rr"))]
    per = _windows(steps, sums, log_steps, run, "step", 1)
    whole, upto = Window.partitionBy(run), Window.partitionBy(run).orderBy("log_window").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("*", F.max("_last").over(whole).alias("_end"), F.sum("_cr").over(upto).alias("_cr_cum"), F.sum("_rr").over(upto).alias("_rr_cum"))
    full = _full(log_steps, 1, F.col("_end"))
    return per.select(
        run, "log_window",
        F.when(full, (F.col("log_window") + 1) * log_steps).otherwise(F.col("_last")).alias("step"),
        (F.col("_loss") / F.col("_n")).alias("loss"),
        F.when(full, F.col("_acc") / F.col("_n")).alias("reward_acc"),
        F.when(full, F.col("_diff") / F.col("_n")).alias("reward_diff"),
        F.when(full, F.col("_cr_cum") / log_steps).alias("chosen_ratio"),
        F.when(full, F.col("_rr_cum") / log_steps).alias("rejected_ratio"),
        F.when(full, F.col("_cr") / F.col("_n")).alias("chosen_ratio_window"),
        F.when(full, F.col("_rr") / F.col("_n")).alias("rejected_ratio_window"),
        (~full).alias("is_final"))


def rollup_rl(prompts: DataFrame, log_steps: int = K.LOG_STEPS, accumulation: int = 16,
              step: str = "prompt_id") -> DataFrame:
    """RL log (G7d) from ``losses.loo_prompts``: loss is the per-step loss / accumulation
    averaged over the window's steps; reward adds one mean per generation chunk, so the
    logged value is the mean over steps of the sum of chunk means (k/chunk times the
    true mean, which is reported too). Only the true last window can be dropped."""
    per = _windows(prompts, [F.sum(F.col("loss") / accumulation).alias("_loss"), F.sum("reward_chunk_sum").alias("_reward"),
                             F.avg("reward_chunk_mean").alias("mean_reward")], log_steps, None, step, 0)
    end = prompts.agg(F.max(step)).scalar()  # a scalar subquery: no join, and no window over all rows
    return per.where(_full(log_steps, 0, end)).select(
        "log_window", ((F.col("log_window") + 1) * log_steps).alias("step"), (F.col("_loss") / F.col("_n")).alias("avg_loss"),
        (F.col("_reward") / F.col("_n")).alias("avg_reward"), "mean_reward")

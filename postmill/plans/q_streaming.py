"""Batch twins of the streaming jobs (K1, K2); the streaming runs are compared
with these twins in tests/test_streaming.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query
from postmill.sources.tables import table
from postmill.streaming.jobs import reward_windows, score_responses


@query("stream_score", f"""
WITH a AS ({S.ANSWERS}) SELECT task_id, response, {S.ANSWER_SCORE} AS score FROM a""")
def stream_score(spark, sf_dir):
    """Arriving responses joined to their task and scored (K1, batch twin)."""
    a = I.answers(spark, sf_dir)
    return score_responses(a.select("task_id", "response"), I.tasks(spark, sf_dir))


@query("stream_reward_window", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS run,
       count(*) AS n, round(avg(value), 6) AS mean_reward
FROM events GROUP BY 1, 2""")
def stream_reward_window(spark, sf_dir):
    """Mean reward per hour and run (K2, batch twin: no watermark)."""
    r = reward_windows(table(spark, sf_dir, "events"), watermark=None)
    return r.withColumn("mean_reward", F.round("mean_reward", 6))

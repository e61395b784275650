"""Inputs derived from the driver tables for the post-training operators.

The driver's tables carry no tasks, scores or log-probs, so they are derived
with integer arithmetic that Spark and the DuckDB oracle compute identically
(the same derivations are spelled in SQL in ``plans/sqlbits.py``). Every row of
the source table contributes; nothing is subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import word_count
from postmill.sources.tables import table

# Coefficients of the task-number generator:
# n_i = 1 + (t * a_i + (t div 99) * b_i + (t div 9801) * c_i + d_i) % 99, so distinct tasks grow with the orders.
TASK_COEFFS = ((7, 5, 3, 3), (13, 17, 7, 5), (29, 31, 19, 11), (41, 2, 37, 17))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as scored candidate responses: (conv_id, turn, text, score)."""
    conv = table(spark, sf_dir, "conversations")
    return (conv.where(F.col("role") == "assistant")
                .select("conv_id", "turn", "text",
                        ((F.length("text") * 7 + F.col("turn") * 3) % 11).cast("double").alias("score")))


def prompt_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """All turns, scored if they are candidates, and the aggregate that gives a
    conversation's prompt, its first user turn; so pairs and prompts are one pass."""
    conv = table(spark, sf_dir, "conversations")
    score = ((F.length("text") * 7 + F.col("turn") * 3) % 11).cast("double")
    turns = conv.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", score).alias("score"))
    return turns, F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdown tasks, one per order: (task_id, nums array<int>, target int)."""
    # Only the ids are dealt out: scoring and prompts cost far more than moving them.
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    o = o.repartition(2 * spark.sparkContext.defaultParallelism, "task_id")
    t = F.col("task_id")
    n = [(F.lit(1) + (t * a + F.floor(t / 99) * b + F.floor(t / 9801) * c + d) % 99).cast("int") for a, b, c, d in TASK_COEFFS]
    four = (t % 2) == 1
    nums = F.when(four, F.array(*n)).otherwise(F.array(*n[:3]))
    target = F.when(t % 4 < 2, F.abs(n[0] + n[1] - n[2] - F.when(four, n[3]).otherwise(F.lit(0))))\
        .otherwise((t * 17 + 3) % 100).cast("int")
    return o.select("task_id", nums.alias("nums"), target.alias("target"))


def _eq_correct(nums: Column) -> Column:
    """``a + b - c - d`` or its negation, whichever is non-negative, as text."""
    s = lambda i: F.element_at(nums, i).cast("string")
    four = F.size(nums) == 4
    n4 = F.when(four, F.element_at(nums, 4)).otherwise(F.lit(0))
    pos = F.element_at(nums, 1) + F.element_at(nums, 2) >= F.element_at(nums, 3) + n4
    fwd = F.when(four, F.concat_ws(" ", s(1), F.lit("+"), s(2), F.lit("-"), s(3), F.lit("-"), s(4)))\
        .otherwise(F.concat_ws(" ", s(1), F.lit("+"), s(2), F.lit("-"), s(3)))
    bwd = F.when(four, F.concat_ws(" ", s(3), F.lit("+"), s(4), F.lit("-"), s(1), F.lit("-"), s(2)))\
        .otherwise(F.concat_ws(" ", s(3), F.lit("-"), s(1), F.lit("-"), s(2)))
    return F.when(pos, fwd).otherwise(bwd)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model responses, one per task: (task_id, nums, target, response).
    The form cycles with ``task_id % 6``: tagged answer, reused number, product,
    untagged, two tags (last wins), tag not on the last line."""
    tk = tasks(spark, sf_dir)
    eq = _eq_correct(F.col("nums"))
    k = F.col("task_id") % 6
    n1 = F.element_at("nums", 1).cast("string")
    resp = (F.when(k == 0, F.concat(F.lit("<think>add and subtract</think>\n<answer>"), eq, F.lit("</answer>")))
             .when(k == 1, F.concat(F.lit("<answer>"), n1, F.lit(" + "), n1, F.lit("</answer>")))
             .when(k == 2, F.concat(F.lit("<answer>"), F.array_join(F.col("nums"), " * "), F.lit("</answer>")))
             .when(k == 3, F.concat(F.lit("I think it is "), eq))
             .when(k == 4, F.concat(F.lit("<answer>1</answer> <answer>"), eq, F.lit("</answer>")))
             .otherwise(F.concat(F.lit("<answer>"), eq, F.lit("</answer>\nDone."))))
    return tk.select("task_id", "nums", "target", resp.alias("response"))


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log-probs per sequence from ``embeddings``: policy = -|x|, reference
    = the reversed array; pad count = label, prompt length = 8 + label."""
    e = table(spark, sf_dir, "embeddings")
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return e.select("vec_id", "label", lp.alias("lp"), F.reverse(lp).alias("lp_ref"),
                    (F.col("label") + 8).alias("prompt_len"),
                    F.col("label").alias("n_pad"))


def rollouts(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """k sampled responses per prompt from ``events``: prompt = event_id div k,
    sample_idx = event_id % k, reward = ln(1 + value), seq log-prob =
    -(user_id % 17) / 4. (Transcendental rewards keep averages off exact
    decimal rounding ties, so both engines round them alike.)"""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id",
                     F.floor(F.col("event_id") / k).alias("prompt_id"),
                     (F.col("event_id") % k).alias("sample_idx"),
                     F.log(F.lit(1.0) + F.col("value")).alias("reward"),
                     (-(F.col("user_id") % 17) / F.lit(4.0)).alias("seq_lp"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-step metrics from ``events``: the event type is the run, step = event_id + 1,
    so every run has gaps and a last step of its own.
    Log and prime divisors keep window means off exact rounding ties."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(F.col("event_type").alias("run"), (F.col("event_id") + 1).alias("step"),
                     F.log(F.lit(1.0) + v).alias("loss"),
                     F.when(v > 250, 1.0).otherwise(0.0).alias("reward_acc"),
                     ((v - 250) / 97.0).alias("reward_diff"),
                     (v / 89.0).alias("chosen_ratio"),
                     (-v / 83.0).alias("rejected_ratio"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokenized documents: one id per space-separated word (id = word length)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("ids"))


def nested_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the nested form that chat corpora are stored in: (conv_id, messages).
    A row of such a corpus is a whole conversation, however it is made."""
    conv = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return conv.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


TRANSCRIPT_ROLES = ("user", "assistant", "system", "tool")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as transcripts, a line a message, the roles in turn: (doc_id, messages)."""
    d = table(spark, sf_dir, "documents")
    role = lambda i: F.element_at(F.array(*map(F.lit, TRANSCRIPT_ROLES)), i % len(TRANSCRIPT_ROLES) + 1)
    return d.select("doc_id", F.transform(F.split("text", "\n"), lambda line, i: F.struct(role(i).alias("role"), line.alias("content"))).alias("messages"))


__all__ = ["candidates", "prompt_turns", "tasks", "answers", "logprobs", "rollouts", "steps",
           "doc_tokens", "word_count", "nested_conversations", "transcripts"]


def reward_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded reward-model replies per candidate (conv_id, turn, reply);
    every ninth is malformed."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    ok = F.concat(F.lit("reward:"), ((F.length("text") % 23) - 11).cast("string"))
    return conv.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit("reward: ???"))
                       .otherwise(ok).alias("reply"))


def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded good/bad responses per benchmark prompt (item_id, variant, response)."""
    b = table(spark, sf_dir, "benchmark")
    v = F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("variant")
    return b.select("item_id", "text", v).select(
        "item_id", "variant", F.concat(F.col("variant"), F.lit(": "), F.col("text")).alias("response"))


def recorded_response_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded reward replies for those responses (item_id, variant, reply)."""
    r = recorded_responses(spark, sf_dir)
    good = (F.length("response") % 31) - 12
    bad = (F.length("response") * 7) % 29 - 14
    return r.select("item_id", "variant", F.concat(F.lit("reward:"), F.when(F.col("variant") == "good", good)
                                                   .otherwise(bad).cast("string")).alias("reply"))


def event_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward replies from ``events``: ``reward:<value*100>``, some with an extra
    colon, some not numeric."""
    ev = table(spark, sf_dir, "events")
    v = F.round(F.col("value") * 100).cast("bigint").cast("string")
    reply = (F.when(F.col("event_id") % 7 == 0, F.lit("reward: n/a"))
              .when(F.col("event_id") % 5 == 0, F.concat(F.lit("score:reward:"), v))
              .otherwise(F.concat(F.lit("reward:"), v)))
    return ev.select("event_id", reply.alias("reply"))

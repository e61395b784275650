"""Enrichment with recorded model outputs (H1-H4).

Generation and reward models are not Spark work; their outputs enter as
recorded tables and are attached with equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.answer import parse_reward

VARIANTS = (("good", K.GOOD_SYSTEM), ("bad", K.BAD_SYSTEM))


def good_bad_requests(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Two requests per prompt with the fixed good/bad system instructions
    (B17). The two-row variant table is a literal array, exploded per row: no
    join, no shuffle."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("system")) for n, s in VARIANTS]))
    return prompts.select("*", v.alias("_v")).select("*", "_v.variant", "_v.system").drop("_v") \
        .withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
                                        F.struct(F.lit("user").alias("role"), F.col(text).alias("content"))))


def reward_request(prompt: str, response: str):
    """``[{user: prompt}, {assistant: response}]``."""
    return F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col(response).alias("content")))


def attach(df: DataFrame, recorded: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach recorded outputs by key (H1/H2). Both sides shuffle on the key;
    AQE splits a skewed key on the large side."""
    return df.join(recorded, keys, how)


def label_candidates(cands: DataFrame, replies: DataFrame, keys: list[str], reply: str = "reply",
                     form: str = "last") -> DataFrame:
    """Candidates with the ``reward`` of their recorded reply (H2, D5), NULL where it does
    not parse; pairing then carries it to both sides (H3), so nothing joins twice."""
    return cands.join(replies.select(*keys, reply), keys, "left").withColumn("reward", parse_reward(F.col(reply), form)).drop(reply)


def require_labels(pairs: DataFrame, chosen: str = "chosen_reward", rejected: str = "rejected_reward") -> DataFrame:
    """Pairs in which either side has no reward get ``reject_reason = 'unlabelled'`` (C9);
    sides are never swapped."""
    return pairs.withColumn("reject_reason", F.when(F.col(chosen).isNull() | F.col(rejected).isNull(), "unlabelled"))


def samples_per_prompt(df: DataFrame, idx: str = "sample_idx", chunk: int = K.GEN_CHUNK) -> DataFrame:
    """k responses per prompt as rows; ``chunk`` is the generation chunk (H4)."""
    return df.withColumn("chunk", F.floor(F.col(idx) / chunk).cast("bigint"))

"""Preference corpora: best/worst pairing, flattening, filters and rendering
(B4, B7-B9, C4-C7, C10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.text import charset_ok, word_count

EOS_TOKEN = "<|endoftext|>"


def best_worst_pairs(cands: DataFrame, key: str = "conv_id", order: str = "turn", text: str | None = "text",
                     score: str = "score", carry: tuple[str, ...] = (), extra: tuple[Column, ...] = ()) -> DataFrame:
    """Highest-scoring candidate becomes ``chosen``, lowest ``rejected`` (ties
    broken by the smaller ``order``); prompts whose best equals their worst
    get ``reject_reason = 'tie'`` (C10, generalised from 2 to k candidates).
    ``max_by``/``min_by`` combine map-side, so a prompt with very many
    candidates is reduced per task, never gathered. Without ``text`` the pair is its two
    ``order`` values and scores, so no text is aggregated. Rows without a score are no
    candidates. Columns ``carry`` of both sides come out as ``chosen_<c>`` and
    ``rejected_<c>``; ``extra`` are further aggregates over all rows of the key, taken
    in the same pass."""
    said = [] if text is None else [F.col(text).alias("t")]
    item = F.struct(F.col(order).alias("o"), *said, F.col(score).alias("s"), *carry)

    def side(s: str, name: str) -> list[Column]:
        texts = [] if text is None else [F.col(f"{s}.t").alias(name)]
        return [F.col(f"{s}.o").alias(f"{name}_turn"), *texts, F.col(f"{s}.s").alias(f"score_{name}")]

    def by(sign):
        return F.when(F.col(score).isNotNull(), F.struct(F.col(score), F.col(order) * sign))

    agg = cands.groupBy(key).agg(F.max_by(item, by(-1)).alias("_b"), F.min_by(item, by(1)).alias("_w"), *extra)
    known = {key, "_b", "_w"}
    out = agg.where(F.col("_b").isNotNull()).select(
        key, *side("_b", "chosen"), *side("_w", "rejected"),
        *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for c in carry for s, name in (("_b", "chosen"), ("_w", "rejected"))],
        *[c for c in agg.columns if c not in known])
    return out.withColumn("reject_reason", F.when(F.col("score_chosen") <= F.col("score_rejected"), "tie"))


def as_raw_preference(pairs: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Nested raw form: ``chosen``/``rejected`` as [user, assistant] message arrays."""
    def conv(side):
        return F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")),
                       F.struct(F.lit("assistant").alias("role"), F.col(side).alias("content")))
    return pairs.select("*", conv("chosen").alias("chosen_msgs"), conv("rejected").alias("rejected_msgs"))


def flatten_preference(raw: DataFrame, prompt: str = "prompt", chosen: str = "chosen_msgs",
                       rejected: str = "rejected_msgs") -> DataFrame:
    """``input = prompt``, ``chosen = chosen[1].content``, ``rejected =
    rejected[1].content`` (second message, 0-based) (B4). A missing second
    message gives NULL and the row is rejected by :func:`preference_filter`."""
    return raw.withColumn("input", F.col(prompt)) \
        .withColumn("chosen", F.get(F.col(chosen), 1)["content"]) \
        .withColumn("rejected", F.get(F.col(rejected), 1)["content"])


def preference_filter(df: DataFrame, max_prompt: int = K.PREF_MAX_PROMPT, max_chosen: int = K.PREF_MAX_CHOSEN,
                      max_rejected: int = K.PREF_MAX_REJECTED, min_chosen: float = K.PREF_MIN_CHOSEN_SCORE,
                      score_chosen: str = "score_chosen", score_rejected: str = "score_rejected") -> DataFrame:
    """Length limits, score floor, strict margin, character whitelist (C4, C5,
    C6). Adds ``reject_reason`` (first failing check, NULL when kept)."""
    sc, sr = F.col(score_chosen), F.col(score_rejected)
    reason = (F.when(F.col("input").isNull() | F.col("chosen").isNull() | F.col("rejected").isNull(), "missing")
               .when(word_count("input") > max_prompt, "prompt_too_long")
               .when(word_count("chosen") > max_chosen, "chosen_too_long")
               .when(word_count("rejected") > max_rejected, "rejected_too_long")
               .when(sc < min_chosen, "low_chosen_score")
               .when(sc <= sr, "no_margin")
               .when(~charset_ok("input"), "charset_prompt")
               .when(~charset_ok("chosen"), "charset_chosen")
               .when(~charset_ok("rejected"), "charset_rejected"))
    return df.withColumn("reject_reason", reason)


def ai_feedback_accept(df: DataFrame, good: str = "good_score", bad: str = "bad_score",
                       min_good: float = K.AIF_MIN_GOOD) -> DataFrame:
    """Keep pairs with ``good > bad`` and ``good >= -10`` (C7); unparsable
    scores are rejected too."""
    g, b = F.col(good), F.col(bad)
    reason = (F.when(g.isNull() | b.isNull(), "unparsable")
               .when(g <= b, "no_margin")
               .when(g < min_good, "low_good_score"))
    return df.withColumn("reject_reason", reason)


# ---- rendering -------------------------------------------------------------

def _chat(role: str, content) -> Column:
    return F.concat(F.lit(f"{K.IM_START}{role}\n"), content, F.lit(f"{K.IM_END}\n"))


def render_train(inp="input", chosen="chosen", rejected="rejected", eos: str = EOS_TOKEN):
    """Preference-training strings (B7): prompt with the default system block;
    ``prompt + answer + end marker + newline + eos``."""
    prompt = F.concat(F.lit(f"{K.IM_START}system\n{K.DEFAULT_SYSTEM}{K.IM_END}\n"), _chat("user", F.col(inp)),
                      F.lit(f"{K.IM_START}assistant\n"))
    tail = F.lit(f"{K.IM_END}\n{eos}")
    return prompt, F.concat(prompt, F.col(chosen), tail), F.concat(prompt, F.col(rejected), tail)


def render_reward(inp="input", chosen="chosen", rejected="rejected"):
    """Reward-model strings (B8): ``input + answer + end marker + newline``,
    no template around the input and no eos."""
    tail = F.lit(f"{K.IM_END}\n")
    return F.concat(F.col(inp), F.col(chosen), tail), F.concat(F.col(inp), F.col(rejected), tail)


def render_eval(inp="input"):
    """Evaluation prompt (B9): user block + assistant header, no system block;
    chosen/rejected are returned unrendered by the caller."""
    return F.concat(_chat("user", F.col(inp)), F.lit(f"{K.IM_START}assistant\n"))


def instruction_prompt(text="text"):
    """Instruction leaderboard prompt (B10): the system block is joined to the
    user block *without* a newline."""
    return F.concat(F.lit(f"{K.IM_START}system\n{K.DEFAULT_SYSTEM}{K.IM_END}{K.IM_START}user\n"),
                    F.col(text), F.lit(f"{K.IM_END}\n{K.IM_START}assistant\n"))

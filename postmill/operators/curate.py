"""Conversation curation: turn selection, message arrays, budgets, shape checks,
chat rendering and filter accounting (B1-B6, C1-C3, G8).

Rows are never dropped silently: every operator adds ``reject_reason`` (NULL
when kept) and callers split with :func:`split_kept`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.text import is_blank, py_strip, word_count


def message(role, content) -> Column:
    role_c = F.lit(role) if isinstance(role, str) else role
    return F.struct(role_c.alias("role"), F.col(content).alias("content") if isinstance(content, str)
                    else content.alias("content"))


def build_messages(user, assistant, system=None) -> Column:
    """``[system?, user, assistant]`` (B2)."""
    parts = [message("user", user), message("assistant", assistant)]
    if system is not None:
        parts.insert(0, message("system", system))
    return F.array(*parts)


def first_message(messages, role: str) -> Column:
    """First message with ``role`` in array order, NULL if none (B3, nested form)."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.try_element_at(F.filter(m, lambda x: x["role"] == role), F.lit(1))


def first_turns(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """First user and first assistant turn per conversation (B3, flat form).

    ``min_by`` is a declarative aggregate, so Spark combines map-side before the
    shuffle: a conversation with a huge number of turns is reduced per task and
    never collected whole.
    """
    def first_of(role):
        return F.min_by("text", F.when(F.col("role") == role, F.col("turn")))

    return conv.groupBy(key).agg(
        first_of("user").alias("user_text"),
        first_of("assistant").alias("assistant_text"),
    )


def role_words(messages, roles) -> Column:
    """Sum of single-space word counts over messages whose role is in ``roles``."""
    m = F.col(messages) if isinstance(messages, str) else messages
    picked = F.filter(m, lambda x: x["role"].isin(list(roles)))
    return F.aggregate(picked, F.lit(0), lambda acc, x: acc + word_count(x["content"]))


def shape_ok(messages, allow_system: bool = False) -> Column:
    """Exactly one user and one assistant message (C3). With ``allow_system`` a
    leading system message is ignored (the reference rejects every row then)."""
    m = F.col(messages) if isinstance(messages, str) else messages
    if allow_system:
        m = F.filter(m, lambda x: x["role"] != "system")
    roles = F.array_sort(F.transform(m, lambda x: x["role"]))
    return (F.size(m) == 2) & (roles == F.array(F.lit("assistant"), F.lit("user")))


def curate_chat(pairs: DataFrame, max_in: int = K.MAX_IN_WORDS, max_out: int = K.MAX_OUT_WORDS,
                use_system: bool = False, system_text: str = "", allow_system: bool = False) -> DataFrame:
    """Chat-corpus curation over first-turn pairs.

    Input: ``user_text``, ``assistant_text`` (either may be NULL).
    Adds ``messages``, ``in_words``, ``out_words``, ``reject_reason``.
    """
    system = F.lit(system_text) if use_system else None
    msgs = F.when(F.col("user_text").isNotNull() & F.col("assistant_text").isNotNull(),
                  build_messages(F.col("user_text"), F.col("assistant_text"), system))
    df = pairs.withColumn("messages", msgs)
    df = (df.withColumn("in_words", role_words("messages", ["system", "user"]))
            .withColumn("out_words", role_words("messages", ["assistant"])))
    reason = (F.when(F.col("messages").isNull(), "missing_role")
               .when(~shape_ok("messages", allow_system), "bad_shape")
               .when((F.col("in_words") > max_in) | (F.col("out_words") > max_out), "over_budget"))
    return df.withColumn("reject_reason", reason)


def parse_warm_start_query(q) -> Column:
    """``q.split("\\nAssistant:")[0].split("User:")[1].strip()``; NULL when no ``User:`` (B1)."""
    c = F.col(q) if isinstance(q, str) else q
    head = F.get(F.split(c, r"\nAssistant:", -1), 0)
    return py_strip(F.get(F.split(head, "User:", -1), 1))


def curate_warm_start(rows: DataFrame, max_in: int = K.MAX_IN_WORDS, max_out: int = K.MAX_OUT_WORDS,
                      use_system: bool = False) -> DataFrame:
    """Warm-start corpus (query, completion) -> messages with budget."""
    df = rows.withColumn("user_content", parse_warm_start_query("query"))
    system = F.lit(K.WARM_START_SYSTEM) if use_system else None
    df = df.withColumn("messages", F.when(F.col("user_content").isNotNull(),
                                         build_messages(F.col("user_content"), F.col("completion"), system)))
    df = (df.withColumn("in_words", role_words("messages", ["system", "user"]))
            .withColumn("out_words", role_words("messages", ["assistant"])))
    reason = (F.when(F.col("user_content").isNull(), "no_user_marker")
               .when((F.col("in_words") > max_in) | (F.col("out_words") > max_out), "over_budget"))
    return df.withColumn("reject_reason", reason)


def split_kept(df: DataFrame):
    """(kept, rejects) by ``reject_reason``; no row lost."""
    return df.where(F.col("reject_reason").isNull()), df.where(F.col("reject_reason").isNotNull())


def filter_counts(df: DataFrame) -> DataFrame:
    """Filter accounting (G8): one row per outcome, ``kept`` included; one pass,
    partial aggregation before a tiny shuffle."""
    return (df.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome"))
              .agg(F.count(F.lit(1)).alias("n")))


# ---- chat rendering (B5, B6) -----------------------------------------------

def render_piece(role, content) -> Column:
    """Text contributed by one message to the training string.

    system: emitted only if non-blank; user: preceded by the default system
    block; assistant: header + content + end marker + newline; others: nothing.
    """
    r = F.col(role) if isinstance(role, str) else role
    c = F.col(content) if isinstance(content, str) else content
    sys_block = F.concat(F.lit(f"{K.IM_START}system\n"), c, F.lit(f"{K.IM_END}\n"))
    user_block = F.concat(F.lit(f"{K.IM_START}system\n{K.DEFAULT_SYSTEM}{K.IM_END}\n{K.IM_START}user\n"),
                          c, F.lit(f"{K.IM_END}\n"))
    asst_block = F.concat(F.lit(f"{K.IM_START}assistant\n"), c, F.lit(f"{K.IM_END}\n"))
    return (F.when(r == "system", F.when(~is_blank(c), sys_block).otherwise(F.lit("")))
             .when(r == "user", user_block)
             .when(r == "assistant", asst_block)
             .otherwise(F.lit("")))


FOLD = 64  # messages folded at once


def render_messages(messages) -> Column:
    """A nested conversation as ``struct<text, spans>``: its training string (B5) and the
    ``start``, ``end`` of each assistant message in it (B6), as :func:`assistant_spans`.

    The row is the conversation, so nothing is shuffled. Pieces are rendered once and
    joined once; a fold over runs of ``FOLD`` pieces carries the offset and the spans, a
    second one over the runs their offsets, so that long conversations do not copy their
    spans at every message. A null array is null, an empty one an empty text; messages of
    a null role or content add nothing.
    """
    m = F.col(messages) if isinstance(messages, str) else messages
    pieces = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.coalesce(render_piece(x["role"], x["content"]), F.lit("")).alias("piece")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    def fold(run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["piece"])
            here = F.array(F.struct((acc["at"] + ASSISTANT_HEADER_LEN).alias("start"), end.alias("end")))
            is_span = F.coalesce(x["role"] == "assistant", F.lit(False)) & (F.length(x["piece"]) > 0)
            return F.struct(end.alias("at"), F.when(is_span, F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def together(runs: Column) -> Column:
        none_yet = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        before = F.aggregate(runs, none_yet, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")),
                             lambda acc: acc["before"])
        return F.flatten(F.zip_with(runs, before, lambda r, by: moved(r["spans"], by)))

    def of(ps: Column) -> Column:
        starts = F.when(F.size(ps) > 0, F.sequence(F.lit(1), F.size(ps), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda k: fold(F.slice(ps, k, F.lit(FOLD))))
        return F.struct(F.array_join(F.transform(ps, lambda x: x["piece"]), "").alias("text"), F.transform(F.array(runs), together)[0].alias("spans"))

    return F.when(m.isNotNull(), F.transform(F.array(pieces), of)[0])


ASSISTANT_HEADER_LEN = len(f"{K.IM_START}assistant\n")
ASSISTANT_TAIL_LEN = len(f"{K.IM_END}\n")


def render_conversations(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """One training string per conversation (B5). The conversation is the unit
    of a training example, so its pieces are concatenated in one group; use
    :func:`assistant_spans` for a per-turn, skew-safe form."""
    pieces = conv.select(key, "turn", render_piece("role", "text").alias("piece"))
    return pieces.groupBy(key).agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY turn)").alias("text"))


def assistant_spans(conv: DataFrame, key: str = "conv_id", chunk: int = 4096) -> DataFrame:
    """Character span of every assistant message in the rendered string.

    start = offset right after the assistant header, end = after the end marker
    and newline (Python slicing offsets). Offsets come from a chunked running
    sum, so no conversation is gathered into a single task.
    """
    from postmill.plans.scan import running_sum

    pieces = conv.select(key, "turn", "role", F.length(render_piece("role", "text")).alias("piece_len"))
    with_off = running_sum(pieces, [key], "turn", "piece_len", "end_off", chunk=chunk)
    return (with_off.where(F.col("role") == "assistant")
            .select(key, "turn",
                    (F.col("end_off") - F.col("piece_len") + ASSISTANT_HEADER_LEN).alias("span_start"),
                    F.col("end_off").alias("span_end")))

"""Curation queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.operators import curate as C
from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query
from postmill.sources.tables import table

NL = "chr(10)"


def _pairs(spark, sf_dir, **kw):
    conv = table(spark, sf_dir, "conversations")
    return C.curate_chat(C.first_turns(conv), **kw)


def _sft_sql(max_in, max_out):
    return f"""
WITH ft AS ({S.first_turns()}),
w AS (SELECT conv_id, user_text, assistant_text, {S.words('user_text')} AS in_words,
             {S.words('assistant_text')} AS out_words
      FROM ft WHERE user_text IS NOT NULL AND assistant_text IS NOT NULL)
SELECT * FROM w WHERE in_words <= {max_in} AND out_words <= {max_out}"""


def _sft(spark, sf_dir, max_in, max_out):
    kept, _ = C.split_kept(_pairs(spark, sf_dir, max_in=max_in, max_out=max_out))
    return kept.select("conv_id", "user_text", "assistant_text", "in_words", "out_words")


@query("sft_pairs", _sft_sql(K.MAX_IN_WORDS, K.MAX_OUT_WORDS))
def sft_pairs(spark, sf_dir):
    """First user + first assistant turn, word budget 128/512."""
    return _sft(spark, sf_dir, K.MAX_IN_WORDS, K.MAX_OUT_WORDS)


@query("sft_pairs_tight", _sft_sql(30, 150))
def sft_pairs_tight(spark, sf_dir):
    """Same with a 30/150 budget, which splits the test data."""
    return _sft(spark, sf_dir, 30, 150)


@query("sft_system_optional", f"""
WITH ft AS ({S.first_turns()}),
w AS (SELECT conv_id,
        CASE WHEN user_text IS NOT NULL AND assistant_text IS NOT NULL THEN 1 + {S.words('user_text')} END AS in_words,
        CASE WHEN user_text IS NOT NULL AND assistant_text IS NOT NULL THEN {S.words('assistant_text')} END AS out_words
      FROM ft)
SELECT conv_id, in_words, out_words, false AS keep_reference,
       coalesce(in_words <= 30 AND out_words <= 150, false) AS keep_system_optional
FROM w""")
def sft_system_optional(spark, sf_dir):
    """System message on (empty text counts one word): the reference shape rule
    rejects every row; the system-optional rule keeps in-budget rows (C3 both modes)."""
    ref = _pairs(spark, sf_dir, max_in=30, max_out=150, use_system=True, system_text="")
    ref = ref.select("conv_id", "user_text", "assistant_text", F.col("reject_reason").isNull().alias("keep_reference"))
    opt = C.curate_chat(ref, max_in=30, max_out=150, use_system=True, system_text="", allow_system=True)
    return opt.select("conv_id", "in_words", "out_words", "keep_reference",
                      F.col("reject_reason").isNull().alias("keep_system_optional"))


@query("filter_report", f"""
WITH ft AS ({S.first_turns()}),
r AS (SELECT CASE WHEN user_text IS NULL OR assistant_text IS NULL THEN 'missing_role'
                  WHEN {S.words('user_text')} > 30 OR {S.words('assistant_text')} > 150 THEN 'over_budget'
                  ELSE 'kept' END AS outcome FROM ft)
SELECT outcome, count(*) AS n FROM r GROUP BY outcome""")
def filter_report(spark, sf_dir):
    """Rows in = kept + rejects, one count per outcome."""
    return C.filter_counts(_pairs(spark, sf_dir, max_in=30, max_out=150))


def _warm_rows(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user")
    prefix = F.when(F.col("turn") % 4 == 2, F.lit("Question: ")).otherwise(F.lit("Context. User: "))
    return user.select("conv_id", "turn",
                       F.concat(prefix, F.col("text"), F.lit("\nAssistant: Let me think.")).alias("query"),
                       F.lit("Sure.").alias("completion"))


@query("warm_start_parse", f"""
WITH q AS (SELECT conv_id, turn,
             CASE WHEN turn % 4 = 2 THEN 'Question: ' ELSE 'Context. User: ' END || text || {NL} || 'Assistant: Let me think.' AS query
           FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, string_split(query, {NL} || 'Assistant:')[1] AS head FROM q),
p AS (SELECT conv_id, turn, CASE WHEN len(string_split(head, 'User:')) >= 2
             THEN {S.strip("string_split(head, 'User:')[2]")} END AS user_content FROM h)
SELECT conv_id, turn, user_content,
       CASE WHEN user_content IS NOT NULL THEN
         {len(K.WARM_START_SYSTEM.split(' '))} + {S.words('user_content')} END AS in_words,
       CASE WHEN user_content IS NULL THEN 'no_user_marker'
            WHEN {len(K.WARM_START_SYSTEM.split(' '))} + {S.words('user_content')} > {K.MAX_IN_WORDS} THEN 'over_budget'
       END AS reject_reason
FROM p""")
def warm_start_parse(spark, sf_dir):
    """Warm-start query parsing with the fixed system message; rows without a
    ``User:`` marker go to rejects instead of failing the job (B1, B2, C1)."""
    out = C.curate_warm_start(_warm_rows(spark, sf_dir), use_system=True)
    return out.select("conv_id", "turn", "user_content", "in_words", "reject_reason")


def _piece_sql():
    sys_b = f"'{K.IM_START}system' || {NL} || text || '{K.IM_END}' || {NL}"
    user_b = (f"'{K.IM_START}system' || {NL} || '{K.DEFAULT_SYSTEM}{K.IM_END}' || {NL} || "
              f"'{K.IM_START}user' || {NL} || text || '{K.IM_END}' || {NL}")
    asst_b = f"'{K.IM_START}assistant' || {NL} || text || '{K.IM_END}' || {NL}"
    return (f"CASE role WHEN 'system' THEN CASE WHEN {S.blank('text')} THEN '' ELSE {sys_b} END "
            f"WHEN 'user' THEN {user_b} WHEN 'assistant' THEN {asst_b} ELSE '' END")


@query("chat_render", f"""
SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text,
       CAST(length(string_agg(piece, '' ORDER BY turn)) AS INTEGER) AS n_chars
FROM (SELECT conv_id, turn, {_piece_sql()} AS piece FROM conversations) GROUP BY conv_id""")
def chat_render(spark, sf_dir):
    """Training string per conversation."""
    out = C.render_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "text", F.length("text").alias("n_chars"))


@query("assistant_spans", f"""
WITH p AS (SELECT conv_id, turn, role, length({_piece_sql()}) AS piece_len FROM conversations),
o AS (SELECT *, sum(piece_len) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS end_off FROM p)
SELECT conv_id, turn, CAST(end_off - piece_len + {C.ASSISTANT_HEADER_LEN} AS BIGINT) AS span_start,
       CAST(end_off AS BIGINT) AS span_end
FROM o WHERE role = 'assistant'""")
def assistant_spans(spark, sf_dir):
    """Character spans of assistant messages in the rendered string."""
    return C.assistant_spans(table(spark, sf_dir, "conversations"))


@query("nested_first_turns", f"""
WITH c AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'user') AS u, list_filter(m, lambda x: x.role = 'assistant') AS a FROM c)
SELECT conv_id, u[1].text AS user_text, a[1].text AS assistant_text,
       CAST(coalesce(list_sum(list_transform(u, lambda x: len(string_split(x.text, ' ')))), 0) AS INTEGER) AS user_words
FROM f""")
def nested_first_turns(spark, sf_dir):
    """First user and assistant message of nested ``messages`` arrays, and the words of
    all user messages (B3 nested form, C1). One row is one conversation, as stored."""
    m = I.nested_conversations(spark, sf_dir)
    return m.select("conv_id", C.first_message("messages", "user")["content"].alias("user_text"),
                    C.first_message("messages", "assistant")["content"].alias("assistant_text"),
                    C.role_words("messages", ["user"]).alias("user_words"))


def _rendered(df, key):
    """Training string and spans of nested ``messages``, the spans as text ``start-end,...``."""
    r = df.select(key, C.render_messages("messages").alias("r"))
    span = F.transform("r.spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return r.select(key, F.col("r.text").alias("text"), F.array_join(span, ",").alias("spans"))


def _rendered_sql(key, rows, order):
    return f"""
WITH p AS (SELECT {key}, {order} AS o, role, {_piece_sql()} AS piece FROM {rows}),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY o ROWS UNBOUNDED PRECEDING) AS e FROM p)
SELECT {key}, string_agg(piece, '' ORDER BY o) AS text,
       coalesce(string_agg((e - length(piece) + {C.ASSISTANT_HEADER_LEN}) || '-' || e, ',' ORDER BY o) FILTER (WHERE role = 'assistant'), '') AS spans
FROM e GROUP BY {key}"""


@query("nested_render", _rendered_sql("conv_id", "conversations", "turn"))
def nested_render(spark, sf_dir):
    """Training string and assistant spans of nested conversations in one pass over each
    row (B5, B6 nested form): the texts of chat_render and the spans of assistant_spans."""
    return _rendered(I.nested_conversations(spark, sf_dir), "conv_id")


_LINES = """(SELECT doc_id, i, (['user', 'assistant', 'system', 'tool'])[(i - 1) % 4 + 1] AS role, ls[i] AS text
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query("transcript_render", _rendered_sql("doc_id", _LINES, "i"))
def transcript_render(spark, sf_dir):
    """The same over documents read as transcripts, a line a message: rows that are nested
    where they lie, with up to hundreds of messages and other roles among them (B5, B6)."""
    return _rendered(I.transcripts(spark, sf_dir), "doc_id")

"""Preference, request and reward-labelling queries (A1, B4, B7-B10, B14,
B16, B17, C4-C7, C9, C10, D5, E1, E4, H1-H3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.answer import parse_reward
from postmill.functions.text import charset_ok
from postmill.operators import batchcall as BC
from postmill.operators import enrich as EN
from postmill.operators import preference as P
from postmill.operators.curate import split_kept, filter_counts
from postmill.operators.sample import epoch_batches as _epoch_batches
from postmill.operators.sample import seeded_sample as _seeded_sample
from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query
from postmill.sources.io import parse_array_lines
from postmill.sources.tables import table

NL = "chr(10)"

PAIRS_SQL = f"""
WITH c AS ({S.CANDIDATES}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rb,
               row_number() OVER (PARTITION BY conv_id ORDER BY score, turn) AS rw FROM c),
b AS (SELECT conv_id, turn AS chosen_turn, text AS chosen, score AS score_chosen FROM r WHERE rb = 1),
w AS (SELECT conv_id, turn AS rejected_turn, text AS rejected, score AS score_rejected FROM r WHERE rw = 1)
SELECT b.conv_id, chosen_turn, chosen, score_chosen, rejected_turn, rejected, score_rejected
FROM b JOIN w ON b.conv_id = w.conv_id WHERE score_chosen > score_rejected"""


def _pairs(spark, sf_dir):
    kept, _ = split_kept(P.best_worst_pairs(I.candidates(spark, sf_dir), text=None))
    return kept.drop("reject_reason")


@query("pref_pairs", f"""
SELECT conv_id, chosen_turn, rejected_turn, score_chosen, score_rejected FROM ({PAIRS_SQL})""")
def pref_pairs(spark, sf_dir):
    """Best and worst scored candidate per prompt, ties dropped."""
    return _pairs(spark, sf_dir).select("conv_id", "chosen_turn", "rejected_turn", "score_chosen", "score_rejected")


def _prompted_pairs(spark, sf_dir):
    """Pairs with their conversation's prompt, in one pass over the turns."""
    turns, prompt = I.prompt_turns(spark, sf_dir)
    kept, _ = split_kept(P.best_worst_pairs(turns, extra=(prompt,)))
    return kept.drop("reject_reason").where(F.col("prompt").isNotNull())


def _filtered(spark, sf_dir):
    raw = P.as_raw_preference(_prompted_pairs(spark, sf_dir)).drop("chosen", "rejected")
    return P.preference_filter(P.flatten_preference(raw))


_FILTER_CASE = f"""CASE WHEN {S.words('prompt')} > {K.PREF_MAX_PROMPT} THEN 'prompt_too_long'
  WHEN {S.words('chosen')} > {K.PREF_MAX_CHOSEN} THEN 'chosen_too_long'
  WHEN {S.words('rejected')} > {K.PREF_MAX_REJECTED} THEN 'rejected_too_long'
  WHEN score_chosen < {K.PREF_MIN_CHOSEN_SCORE} THEN 'low_chosen_score'
  WHEN score_chosen <= score_rejected THEN 'no_margin'
  WHEN NOT {S.charset('prompt')} THEN 'charset_prompt'
  WHEN NOT {S.charset('chosen')} THEN 'charset_chosen'
  WHEN NOT {S.charset('rejected')} THEN 'charset_rejected' END"""


@query("pref_filter", f"""
WITH p AS ({PAIRS_SQL}), j AS (SELECT p.*, pr.prompt FROM p JOIN ({S.PROMPTS}) pr ON p.conv_id = pr.conv_id)
SELECT conv_id, prompt AS input, chosen, rejected FROM j WHERE ({_FILTER_CASE}) IS NULL""")
def pref_filter(spark, sf_dir):
    """Flatten nested preferences and apply length, score, margin and
    charset filters (B4, C4, C5, C6)."""
    kept, _ = split_kept(_filtered(spark, sf_dir))
    return kept.select("conv_id", "input", "chosen", "rejected")


@query("pref_filter_report", f"""
WITH p AS ({PAIRS_SQL}), j AS (SELECT p.*, pr.prompt FROM p JOIN ({S.PROMPTS}) pr ON p.conv_id = pr.conv_id)
SELECT coalesce({_FILTER_CASE}, 'kept') AS outcome, count(*) AS n FROM j GROUP BY 1""")
def pref_filter_report(spark, sf_dir):
    """Kept / rejected counts per first failing check (G8 for C4-C6)."""
    return filter_counts(_filtered(spark, sf_dir))


@query("charset_filter", f"""
SELECT doc_id, lang, {S.charset('text')} AS charset_ok FROM documents""")
def charset_filter(spark, sf_dir):
    """Character whitelist over whole documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", charset_ok("text").alias("charset_ok"))


def _render_sql():
    sysb = f"'{K.IM_START}system' || {NL} || '{K.DEFAULT_SYSTEM}{K.IM_END}' || {NL}"
    userb = f"'{K.IM_START}user' || {NL} || prompt || '{K.IM_END}' || {NL}"
    ah = f"'{K.IM_START}assistant' || {NL}"
    tail = f"'{K.IM_END}' || {NL}"
    tp = f"({sysb} || {userb} || {ah})"
    return (f"{tp} AS train_prompt, {tp} || chosen || {tail} || '{P.EOS_TOKEN}' AS train_chosen, "
            f"{tp} || rejected || {tail} || '{P.EOS_TOKEN}' AS train_rejected, "
            f"prompt || chosen || {tail} AS rm_chosen, prompt || rejected || {tail} AS rm_rejected, "
            f"{userb} || {ah} AS eval_prompt")


@query("pref_render", f"""
WITH p AS ({PAIRS_SQL}), j AS (SELECT p.*, pr.prompt FROM p JOIN ({S.PROMPTS}) pr ON p.conv_id = pr.conv_id)
SELECT conv_id, {_render_sql()} FROM j""")
def pref_render(spark, sf_dir):
    """Training (B7), reward-model (B8) and evaluation (B9) renderings."""
    j = _prompted_pairs(spark, sf_dir).withColumnRenamed("prompt", "input")
    tp, tc, tr = P.render_train()
    rc, rr = P.render_reward()
    return j.select("conv_id", tp.alias("train_prompt"), tc.alias("train_chosen"), tr.alias("train_rejected"),
                    rc.alias("rm_chosen"), rr.alias("rm_rejected"), P.render_eval().alias("eval_prompt"))


@query("instruction_prompt", f"""
SELECT item_id, '{K.IM_START}system' || {NL} || '{K.DEFAULT_SYSTEM}{K.IM_END}{K.IM_START}user' || {NL} || text
       || '{K.IM_END}' || {NL} || '{K.IM_START}assistant' || {NL} AS prompt FROM benchmark""")
def instruction_prompt(spark, sf_dir):
    """Instruction leaderboard prompt."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", P.instruction_prompt().alias("prompt"))


@query("good_bad_requests", f"""
SELECT item_id, 'good' AS variant, '{K.GOOD_SYSTEM}' AS system, text AS user_text FROM benchmark
UNION ALL
SELECT item_id, 'bad', '{K.BAD_SYSTEM}', text FROM benchmark""")
def good_bad_requests(spark, sf_dir):
    """Two generation requests per prompt."""
    r = EN.good_bad_requests(table(spark, sf_dir, "benchmark"))
    return r.select("item_id", "variant", F.get("messages", 0)["content"].alias("system"),
                    F.get("messages", 1)["content"].alias("user_text"))


@query("ai_feedback_accept", f"""
WITH r AS (SELECT item_id, 'good' AS variant, 'good: ' || text AS response FROM benchmark
           UNION ALL SELECT item_id, 'bad', 'bad: ' || text FROM benchmark),
s AS (SELECT item_id, variant, CASE WHEN variant = 'good' THEN 'reward:' || ((length(response) % 31) - 12)
                                     ELSE 'reward:' || ((length(response) * 7) % 29 - 14) END AS reply FROM r),
p AS (SELECT item_id, variant, TRY_CAST({S.strip("string_split(reply, ':')[2]")} AS DOUBLE) AS score FROM s),
v AS (SELECT item_id, max(score) FILTER (WHERE variant = 'good') AS good_score,
             max(score) FILTER (WHERE variant = 'bad') AS bad_score FROM p GROUP BY item_id)
SELECT item_id, good_score, bad_score FROM v WHERE good_score > bad_score AND good_score >= {K.AIF_MIN_GOOD}""")
def ai_feedback_accept(spark, sf_dir):
    """Requests (B17) -> recorded responses (H1) -> reward requests (B16) ->
    recorded reward replies (H2), first-colon parse (D5) -> accept (C7)."""
    req = EN.good_bad_requests(table(spark, sf_dir, "benchmark"))
    resp = EN.attach(req, I.recorded_responses(spark, sf_dir), ["item_id", "variant"], "inner")
    resp = resp.withColumn("reward_request", EN.reward_request("text", "response"))
    rew = EN.attach(resp, I.recorded_response_rewards(spark, sf_dir), ["item_id", "variant"], "left")
    rew = rew.withColumn("score", parse_reward(F.col("reply"), "first"))
    piv = rew.groupBy("item_id").agg(F.max(F.when(F.col("variant") == "good", F.col("score"))).alias("good_score"),
                                     F.max(F.when(F.col("variant") == "bad", F.col("score"))).alias("bad_score"))
    kept, _ = split_kept(P.ai_feedback_accept(piv))
    return kept.select("item_id", "good_score", "bad_score")


@query("reward_parse", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'reward: n/a'
                    WHEN event_id % 5 = 0 THEN 'score:reward:' || CAST(round(value * 100) AS BIGINT)
                    ELSE 'reward:' || CAST(round(value * 100) AS BIGINT) END AS reply FROM events)
SELECT event_id, TRY_CAST({S.strip("string_split(reply, ':')[-1]")} AS DOUBLE) AS reward_last,
       TRY_CAST({S.strip("string_split(reply, ':')[2]")} AS DOUBLE) AS reward_first FROM e""")
def reward_parse(spark, sf_dir):
    """Reward-model reply parsing, last-colon and first-colon forms."""
    r = I.event_replies(spark, sf_dir)
    return r.select("event_id", parse_reward(F.col("reply"), "last").alias("reward_last"),
                    parse_reward(F.col("reply"), "first").alias("reward_first"))


@query("reward_label", f"""
WITH p AS ({PAIRS_SQL}),
rp AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'reward: ???'
              ELSE 'reward:' || ((length(text) % 23) - 11) END AS reply FROM conversations WHERE role = 'assistant'),
v AS (SELECT conv_id, turn, TRY_CAST({S.strip("string_split(reply, ':')[-1]")} AS DOUBLE) AS r FROM rp),
j AS (SELECT p.conv_id, c.r AS chosen_reward, x.r AS rejected_reward FROM p
      LEFT JOIN v c ON c.conv_id = p.conv_id AND c.turn = p.chosen_turn
      LEFT JOIN v x ON x.conv_id = p.conv_id AND x.turn = p.rejected_turn)
SELECT * FROM j WHERE chosen_reward IS NOT NULL AND rejected_reward IS NOT NULL""")
def reward_label(spark, sf_dir):
    """Two-sided reward labelling from recorded replies; unparsable rows are
    dropped and counted, never failing the job (H2, H3, C9)."""
    cands = EN.label_candidates(I.candidates(spark, sf_dir), I.reward_replies(spark, sf_dir), ["conv_id", "turn"])
    pairs, _ = split_kept(P.best_worst_pairs(cands, text=None, carry=("reward",)))
    kept, _ = split_kept(EN.require_labels(pairs.drop("reject_reason")))
    return kept.select("conv_id", "chosen_reward", "rejected_reward")


@query("seeded_sample", f"""
SELECT doc_id, lang FROM documents ORDER BY md5('{K.SAMPLE_SEED}:' || doc_id), doc_id LIMIT 100""")
def seeded_sample(spark, sf_dir):
    """Reproducible seeded sample of n rows."""
    d = table(spark, sf_dir, "documents")
    return _seeded_sample(d, 100, K.SAMPLE_SEED, "doc_id").select("doc_id", "lang")


@query("epoch_batches", f"""
WITH e AS (SELECT event_id, CAST(ep.epoch AS INTEGER) AS epoch FROM events, range(2) ep(epoch))
SELECT event_id, epoch, idx, CAST(idx // 4 AS BIGINT) AS batch_id FROM (
  SELECT event_id, epoch, CAST(row_number() OVER (PARTITION BY epoch
         ORDER BY md5('{K.SAMPLE_SEED}:' || epoch || ':' || event_id), event_id) - 1 AS BIGINT) AS idx FROM e)""")
def epoch_batches(spark, sf_dir):
    """Per-epoch shuffle, global position and batch id, 2 epochs of batch 4."""
    ev = table(spark, sf_dir, "events").select("event_id")
    return _epoch_batches(ev, "event_id", 2, 4, K.SAMPLE_SEED).select("event_id", "epoch", "idx", "batch_id")


@query("union_sources", """
SELECT 'documents' AS source, doc_id AS id, CAST(length(text) AS INTEGER) AS n_chars FROM documents
UNION ALL
SELECT 'benchmark', item_id, CAST(length(text) AS INTEGER) FROM benchmark""")
def union_sources(spark, sf_dir):
    """Several sources concatenated, duplicates kept (A1)."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), "text")
    return d.unionByName(b).select("source", "id", F.length("text").alias("n_chars"))


@query("json_array_rows", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 3 THEN '{"k": ' ELSE props END AS body FROM events)
SELECT event_id, TRY_CAST(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.k') END AS BIGINT) AS k,
       NOT json_valid(body) AS rejected FROM e""")
def json_array_rows(spark, sf_dir):
    """Elements of a JSON array, one a line, with an explicit schema; elements that do
    not parse are kept as rejects (A1, A2)."""
    body = F.when(F.col("event_id") % 11 == 3, '{"k": ').otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(
        F.when(F.col("event_id") == 0, "[ ").otherwise("  "), body, F.lit(" ,")).alias("line"))
    r = parse_array_lines(lines, "line", "k bigint")
    return r.select("event_id", F.when(~F.col("rejected"), F.col("row.k")).alias("k"), "rejected")


@query("reward_requests", """
WITH r AS (SELECT item_id, 'good' AS variant, text, 'good: ' || text AS response FROM benchmark
           UNION ALL SELECT item_id, 'bad', text, 'bad: ' || text FROM benchmark)
SELECT item_id, variant, '[{"role":"user","content":' || to_json(text) || '},{"role":"assistant","content":' || to_json(response)
       || '}]' AS request FROM r""")
def reward_requests(spark, sf_dir):
    """Reward-model requests as JSON text, one line per recorded response."""
    r = I.recorded_responses(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), "item_id")
    return r.select("item_id", "variant", F.to_json(EN.reward_request("text", "response")).alias("request"))


def _answer(frame):
    """Stands in for a model: the last word but one of the instruction, then the prompt; some prompts are refused."""
    refused = frame["item_id"][frame["item_id"] % 7 == 3]
    if len(refused):
        raise RuntimeError(f"refused {refused.iloc[0]}")
    return {"response": [f"{m[0]['content'].split(' ')[-2]} {m[1]['content']}" for m in frame["messages"]]}


def _judge(frame):
    """Stands in for a reward model: replies by the response's length, some without a number."""
    n = [len(m[1]["content"]) for m in frame["reward_request"]]
    return {"reply": ["reward: ???" if k % 11 == 4 else f"reward:{k * 7 % 29 - 14}" for k in n]}


def _batch_responses(spark, sf_dir):
    return BC.respond(EN.good_bad_requests(table(spark, sf_dir, "benchmark")), _answer, ("item_id", "messages"), batch_rows=8)


RESPONSES_SQL = f"""
SELECT item_id, variant, CASE WHEN item_id % 7 <> 3 THEN string_split(system, ' ')[-2] || ' ' || text END AS response,
       CASE WHEN item_id % 7 = 3 THEN 'RuntimeError: refused ' || item_id END AS reject_reason
FROM (SELECT item_id, 'good' AS variant, '{K.GOOD_SYSTEM}' AS system, text FROM benchmark
      UNION ALL SELECT item_id, 'bad', '{K.BAD_SYSTEM}', text FROM benchmark)"""


@query("batch_responses", RESPONSES_SQL)
def batch_responses(spark, sf_dir):
    """Good and bad requests of every prompt through a function over bounded batches;
    only the rows that it refuses become rejects (B17, H1)."""
    return _batch_responses(spark, sf_dir).select("item_id", "variant", "response", "reject_reason")


@query("batch_rewards", f"""
WITH r AS ({RESPONSES_SQL}),
s AS (SELECT item_id, variant, CASE WHEN length(response) % 11 <> 4 THEN CAST(length(response) * 7 % 29 - 14 AS DOUBLE) END AS score
      FROM r WHERE reject_reason IS NULL),
v AS (SELECT item_id, max(score) FILTER (WHERE variant = 'good') AS good_score, max(score) FILTER (WHERE variant = 'bad') AS bad_score
      FROM s GROUP BY item_id)
SELECT item_id, good_score, bad_score, CASE WHEN good_score IS NULL OR bad_score IS NULL THEN 'unparsable'
       WHEN good_score <= bad_score THEN 'no_margin' WHEN good_score < {K.AIF_MIN_GOOD} THEN 'low_good_score' END AS reject_reason FROM v""")
def batch_rewards(spark, sf_dir):
    """Responses by a function, reward requests, rewards by a second function, replies
    parsed and pairs accepted (B16, H1, H2, D5, C7)."""
    kept, _ = split_kept(_batch_responses(spark, sf_dir))
    asked = kept.drop("reject_reason").withColumn("reward_request", EN.reward_request("text", "response"))
    scored = BC.reward(asked, _judge, batch_rows=8)
    sides = scored.groupBy("item_id").agg(F.max(F.when(F.col("variant") == "good", F.col("score"))).alias("good_score"),
                                          F.max(F.when(F.col("variant") == "bad", F.col("score"))).alias("bad_score"))
    return P.ai_feedback_accept(sides).select("item_id", "good_score", "bad_score", "reject_reason")

"""Token-array, loss-statistic, evaluation and log-rollup queries (F1-F6,
G1-G10, H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.answer import score_answers
from postmill.operators import enrich as EN
from postmill.operators import evals as EV
from postmill.operators import losses as LS
from postmill.operators import tokens as T
from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query
from postmill.plans.scan import running_sum
from postmill.sources.tables import table

SEQ = 1280  # sequence length of the supervised rows
L = 64      # token log-probs of a recorded sequence (the length of its array)


def _txt(arr):
    return F.array_join(arr.cast("array<string>"), ",")


DOC_IDS = "list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER))"


@query("pad_truncate", f"""
WITH d AS (SELECT doc_id, {DOC_IDS} AS ids FROM documents)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       array_to_string(list_resize(ids[1:{SEQ}], {SEQ}, 0), ',') AS ids_right,
       CAST(least(len(ids), {SEQ}) AS INTEGER) AS mask_sum,
       array_to_string(list_concat(list_transform(range(greatest(0, {SEQ} - len(ids))), lambda x: 0), ids[1:{SEQ}]), ',') AS ids_left
FROM d""")
def pad_truncate(spark, sf_dir):
    """Truncate / pad to a fixed length with an attention mask, right and left (F1)."""
    d = I.doc_tokens(spark, sf_dir)
    r_ids, r_mask = T.pad_truncate("ids", SEQ, 0, "right")
    l_ids, _ = T.pad_truncate("ids", SEQ, 0, "left")
    return d.select("doc_id", F.size("ids").alias("n_tokens"), _txt(r_ids).alias("ids_right"),
                    T.prompt_length(r_mask).alias("mask_sum"), _txt(l_ids).alias("ids_left"))


def _conv_tokens(spark, sf_dir, most):
    """Turns with their token offsets; of a turn's tokens the first ``most``, as no row of
    ``most`` tokens can hold more, so whole token arrays never cross the shuffle."""
    conv = table(spark, sf_dir, "conversations")
    t = conv.select("conv_id", "turn", "role", F.split("text", " ", -1).alias("words"))
    t = t.select("conv_id", "turn", "role", F.size("words").alias("n_tok"), F.transform(F.slice("words", 1, most), lambda w: F.length(w)).alias("tok"))
    t = running_sum(t, ["conv_id"], "turn", "n_tok", "end_tok")
    return t.withColumn("start_tok", F.col("end_tok") - F.col("n_tok"))


@query("sft_labels", f"""
WITH t AS (SELECT conv_id, turn, role, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS tok
           FROM conversations),
o AS (SELECT *, sum(len(tok)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM t),
o2 AS (SELECT *, e - len(tok) AS s FROM o),
c AS (SELECT conv_id, flatten(list(tok ORDER BY turn)) AS ids,
             arg_max(s, turn) FILTER (WHERE role = 'assistant') AS ls,
             arg_max(e, turn) FILTER (WHERE role = 'assistant') AS le,
             list(e) FILTER (WHERE role = 'assistant') AS ends FROM o2 GROUP BY conv_id),
p AS (SELECT conv_id, list_resize(ids[1:{SEQ}], {SEQ}, 0) AS pid, least(len(ids), {SEQ}) AS n_real, ls, le,
             coalesce(ends, []) AS ends FROM c),
q AS (SELECT conv_id,
        list_transform(range({SEQ}), lambda i: CASE WHEN ls IS NOT NULL AND i >= least(ls, {SEQ})
            AND (i < least(le, {SEQ}) OR (i = least(le, {SEQ}) AND least(le, {SEQ}) < {SEQ})) THEN pid[i + 1] ELSE -100 END) AS labels,
        list_transform(range({SEQ}), lambda i: CASE WHEN i < n_real
            OR list_contains(list_transform(ends, lambda x: least(x, {SEQ - 1})), i) THEN 1 ELSE 0 END) AS mask
      FROM p)
SELECT conv_id, array_to_string(labels, ',') AS labels, array_to_string(mask, ',') AS mask,
       CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_labels FROM q""")
def sft_labels(spark, sf_dir):
    """Loss labels from assistant spans, only the last span kept (F2). Token
    offsets are a chunked running sum; only turns starting inside the first
    SEQ tokens are gathered, so a conversation never collects more than SEQ ids."""
    t = _conv_tokens(spark, sf_dir, SEQ)
    asst, inside = F.col("role") == "assistant", F.col("start_tok") < SEQ
    span = F.struct("turn", F.col("start_tok").alias("start"), F.col("end_tok").alias("end"))
    part = F.struct("turn", F.slice("tok", 1, F.greatest(F.lit(0), F.lit(SEQ) - F.col("start_tok").cast("int"))).alias("part"))
    c = t.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(inside, part))), lambda s: s["part"])).alias("ids"),
        F.array_sort(F.collect_list(F.when(asst & inside, span))).alias("in_spans"),
        F.max("end_tok").alias("n_total"), F.max(F.when(asst, span)).alias("last_span"))
    spans = F.transform(F.concat("in_spans", F.filter(F.array("last_span"), lambda s: s.isNotNull())),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    pid, _ = T.pad_truncate("ids", SEQ, 0, "right")
    c = c.select("conv_id", pid.alias("pid"), F.least(F.col("n_total"), F.lit(SEQ)).alias("n_real"), spans.alias("spans"))
    labels, mask = T.span_labels("pid", "n_real", "spans", SEQ, keep="last")
    c = c.select("conv_id", labels.alias("labels"), mask.alias("mask"))
    return c.select("conv_id", _txt(F.col("labels")).alias("labels"), _txt(F.col("mask")).alias("mask"),
                    F.size(F.filter("labels", lambda x: x != K.IGNORE_INDEX)).alias("n_labels"))


def _seq_lp(spark, sf_dir):
    lp = I.logprobs(spark, sf_dir)
    am = F.transform(F.sequence(F.lit(0), F.lit(L)), lambda j: F.when(j < L + 1 - F.col("n_pad"), 1).otherwise(0))
    pmask = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.when(j < F.col("prompt_len"), 1).otherwise(0))
    lp = lp.withColumn("am", am).withColumn("pmask", pmask)
    lp = lp.withColumn("m_pref", T.response_mask("am", T.prompt_length("pmask", minus=1)))
    lp = lp.withColumn("m_rl", T.response_mask("am", T.prompt_length("pmask")))
    return lp.select("vec_id", "label", "lp",
                     T.prompt_length("pmask").alias("prompt_len"),
                     LS.mask_count("m_pref").alias("n_resp_pref"),
                     LS.masked_sum("lp", "m_pref").alias("lp_sum"),
                     LS.masked_sum("lp_ref", "m_pref").alias("ref_lp_sum"),
                     LS.mask_count("m_rl").alias("n_resp_rl"),
                     LS.masked_mean("lp", "m_rl").alias("lp_mean"))


def _lp_sql(arr: str, off: int, what: str) -> str:
    cond = f"i >= prompt_len - {off} AND i + 1 < {L + 1} - n_pad"
    if what == "count":
        return f"CAST(list_sum(list_transform(range({L}), lambda i: CASE WHEN {cond} THEN 1 ELSE 0 END)) AS INTEGER)"
    return f"list_sum(list_transform(range({L}), lambda i: CASE WHEN {cond} THEN {arr}[i + 1] ELSE 0.0 END))"


SEQ_SQL = f"""SELECT vec_id, label, prompt_len, {_lp_sql('lp', 1, 'count')} AS n_resp_pref,
       {_lp_sql('lp', 1, 'sum')} AS lp_sum, {_lp_sql('lp_ref', 1, 'sum')} AS ref_lp_sum,
       {_lp_sql('lp', 0, 'count')} AS n_resp_rl,
       {_lp_sql('lp', 0, 'sum')} / greatest(1, {_lp_sql('lp', 0, 'count')}) AS lp_mean
FROM ({S.LOGPROBS})"""


@query("seq_logprob", f"""
SELECT vec_id, prompt_len, n_resp_pref, round(lp_sum, 6) AS lp_sum, n_resp_rl, round(lp_mean, 6) AS lp_mean
FROM ({SEQ_SQL})""")
def seq_logprob(spark, sf_dir):
    """Prompt length (F3), shifted response masks (F4), summed (G1) and mean
    (G2) sequence log-probs; preference form subtracts 1 from the prompt length."""
    s = _seq_lp(spark, sf_dir)
    return s.select("vec_id", "prompt_len", "n_resp_pref", F.round("lp_sum", 6).alias("lp_sum"),
                    "n_resp_rl", F.round("lp_mean", 6).alias("lp_mean"))


@query("seq_logprob_left", f"""
SELECT vec_id, prompt_len, n_resp_pref AS n_resp, round(lp_sum, 6) AS lp_sum, round(lp_mean, 6) AS lp_mean_rl,
       CAST(list_sum(list_transform(range({L}), lambda i: CASE WHEN i >= prompt_len AND i + 1 >= n_pad THEN 1 ELSE 0 END)) AS INTEGER) AS n_unaligned
FROM (SELECT r.*, n_pad FROM ({SEQ_SQL}) r JOIN (SELECT vec_id, label AS n_pad FROM embeddings) USING (vec_id))""")
def seq_logprob_left(spark, sf_dir):
    """The same sequences padded on the left: masks aligned at the first real token give the
    sums of the right-padded rows (F3, F4, G1, G2). ``n_unaligned`` counts what the formula
    without an offset keeps, prompt tokens among them."""
    lp = I.logprobs(spark, sf_dir).withColumn("prompt_len", F.col("prompt_len").cast("int"))
    am = F.transform(F.sequence(F.lit(0), F.lit(L)), lambda j: F.when(j >= F.col("n_pad"), 1).otherwise(0))
    lp = lp.withColumn("am", am).withColumn("left", T.left_padded("lp", "n_pad", -1e9))
    lp = lp.withColumn("m_pref", T.response_mask("am", F.col("prompt_len") - 1)).withColumn("m_rl", T.response_mask("am", "prompt_len"))
    return lp.select("vec_id", "prompt_len", LS.mask_count("m_pref").alias("n_resp"), F.round(LS.masked_sum("left", "m_pref"), 6).alias("lp_sum"),
                     F.round(LS.masked_mean("left", "m_rl"), 6).alias("lp_mean_rl"),
                     LS.mask_count(T.response_mask("am", "prompt_len", prompt_offset=0)).alias("n_unaligned"))


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _ls(x):
    return f"(CASE WHEN {x} >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"


@query("pref_loss_stats", f"""
WITH s AS ({SEQ_SQL}),
p AS (SELECT vec_id // 2 AS pair_id,
        max(lp_sum) FILTER (WHERE vec_id % 2 = 0) AS pc, max(ref_lp_sum) FILTER (WHERE vec_id % 2 = 0) AS rc,
        max(lp_sum) FILTER (WHERE vec_id % 2 = 1) AS pr, max(ref_lp_sum) FILTER (WHERE vec_id % 2 = 1) AS rr,
        count(*) AS n FROM s GROUP BY 1),
q AS (SELECT pair_id // 4 AS batch_id, pc - rc AS cr, pr - rr AS rjr FROM p WHERE n = 2)
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(avg(-{_ls(f'{K.DPO_BETA} * (cr - rjr)')}), 6) AS loss,
       round(avg(CASE WHEN cr > rjr THEN 1.0 ELSE 0.0 END), 6) AS reward_acc,
       round(avg(cr - rjr), 6) AS reward_diff, round(avg(cr), 6) AS chosen_ratio, round(avg(rjr), 6) AS rejected_ratio,
       count(*) AS n_pairs
FROM q GROUP BY batch_id""")
def pref_loss_stats(spark, sf_dir):
    """Preference-loss statistics per batch of 4 pairs, beta 0.1."""
    s = _seq_lp(spark, sf_dir).withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    even = F.col("vec_id") % 2 == 0
    p = s.groupBy("pair_id").agg(
        F.max(F.when(even, F.col("lp_sum"))).alias("chosen_lp"), F.max(F.when(even, F.col("ref_lp_sum"))).alias("chosen_ref_lp"),
        F.max(F.when(~even, F.col("lp_sum"))).alias("rejected_lp"), F.max(F.when(~even, F.col("ref_lp_sum"))).alias("rejected_ref_lp"),
        F.count(F.lit(1)).alias("_n"))
    p = p.where(F.col("_n") == 2).withColumn("batch_id", F.floor(F.col("pair_id") / 4).cast("bigint"))
    st = LS.preference_stats(p, "batch_id")
    return st.select("batch_id", *_r6("loss", "reward_acc", "reward_diff", "chosen_ratio", "rejected_ratio"), "n_pairs")


@query("bt_loss", f"""
WITH r AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS reward FROM embeddings),
p AS (SELECT vec_id // 2 AS pair_id, max(reward) FILTER (WHERE vec_id % 2 = 0) AS c,
             max(reward) FILTER (WHERE vec_id % 2 = 1) AS r, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(pair_id // 4 AS BIGINT) AS batch_id, round(avg(-{_ls('c - r')}), 6) AS loss, count(*) AS n_pairs
FROM p WHERE n = 2 GROUP BY 1""")
def bt_loss(spark, sf_dir):
    """Bradley-Terry reward-model loss per batch of 4 pairs."""
    e = table(spark, sf_dir, "embeddings")
    r = e.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("reward"))
    r = r.withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    even = F.col("vec_id") % 2 == 0
    p = r.groupBy("pair_id").agg(F.max(F.when(even, F.col("reward"))).alias("chosen_reward"),
                                 F.max(F.when(~even, F.col("reward"))).alias("rejected_reward"),
                                 F.count(F.lit(1)).alias("_n"))
    p = p.where(F.col("_n") == 2).withColumn("batch_id", F.floor(F.col("pair_id") / 4).cast("bigint"))
    return LS.bradley_terry(p, "batch_id").select("batch_id", F.round("loss", 6).alias("loss"), "n_pairs")


LOO_SQL = f"""
WITH r AS ({S.ROLLOUTS}),
t AS (SELECT prompt_id, sum(reward) AS s, count(*) AS k FROM r GROUP BY prompt_id)
SELECT r.*, t.k, r.reward - CASE WHEN t.k > 1 THEN (t.s - r.reward) / (t.k - 1) END AS advantage
FROM r JOIN t ON r.prompt_id = t.prompt_id"""


@query("loo_advantage", f"""
SELECT event_id, prompt_id, round(advantage, 6) AS advantage FROM ({LOO_SQL})""")
def loo_advantage(spark, sf_dir):
    """Leave-one-out baseline and advantage over k=16 samples per prompt."""
    a = LS.leave_one_out(I.rollouts(spark, sf_dir))
    return a.select("event_id", "prompt_id", F.round("advantage", 6).alias("advantage"))


@query("loo_loss", f"""
WITH a AS ({LOO_SQL}),
c AS (SELECT prompt_id, sample_idx // 2 AS chunk, avg(reward) AS cm FROM a GROUP BY 1, 2),
cs AS (SELECT prompt_id, sum(cm) AS reward_chunk_sum FROM c GROUP BY 1)
SELECT a.prompt_id, max(k) AS k, round(-avg(advantage * seq_lp), 6) AS loss,
       round(max(cs.reward_chunk_sum), 6) AS reward_chunk_sum
FROM a JOIN cs ON a.prompt_id = cs.prompt_id GROUP BY a.prompt_id""")
def loo_loss(spark, sf_dir):
    """Leave-one-out loss per prompt, and the per-prompt sum of generation-chunk
    mean rewards that the RL log accumulates (G5, H4)."""
    r = LS.loo_prompts(EN.samples_per_prompt(I.rollouts(spark, sf_dir)))
    return r.select("prompt_id", "k", F.round("loss", 6).alias("loss"), F.round("reward_chunk_sum", 6).alias("reward_chunk_sum"))


@query("batch_collate", f"""
WITH d AS (SELECT doc_id, doc_id // 4 AS batch_id, {DOC_IDS} AS ids FROM documents),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_len FROM d)
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(padded_len AS INTEGER) AS padded_len,
       CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS n_nonpad,
       array_to_string(list_concat(ids, list_transform(range(padded_len - len(ids)), lambda x: 0)), ',') AS ids,
       array_to_string(list_concat(list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END),
                                   list_transform(range(padded_len - len(ids)), lambda x: 0)), ',') AS mask FROM m""")
def batch_collate(spark, sf_dir):
    """Pad each batch to its longest row (F5) and count non-pad ids."""
    d = I.doc_tokens(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 4).cast("bigint"))
    c = T.collate(d, "batch_id", "ids", 0)
    mask = T.nonpad_mask("ids", 0)
    return c.select("doc_id", "batch_id", "padded_len", F.size(F.filter(mask, lambda m: m)).alias("n_nonpad"),
                    _txt(F.col("ids")).alias("ids"), _txt(F.transform(mask, lambda m: m.cast("int"))).alias("mask"))


ANS_SCORES = f"WITH a AS ({S.ANSWERS}) SELECT task_id, {S.ANSWER_SCORE} AS score FROM a"


@query("eval_mean", f"""
SELECT count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score = 0) AS n_zero,
       count(*) FILTER (WHERE score = 0.1) AS n_format, count(*) FILTER (WHERE score = 1.0) AS n_correct
FROM ({ANS_SCORES})""")
def eval_mean(spark, sf_dir):
    """Mean score and counts per score class over a run."""
    s = score_answers(I.answers(spark, sf_dir), "response", "nums", "target")
    out = EV.score_summary(s)
    return out.select("n", F.round("mean_score", 6).alias("mean_score"), "n_zero", "n_format", "n_correct")


RUN_SCORES = "SELECT event_type AS run, user_id AS item, avg(value) AS score FROM events GROUP BY 1, 2"


def _run_scores(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("item")).agg(F.avg("value").alias("score"))


@query("win_rate", f"""
WITH s AS ({RUN_SCORES}), b AS (SELECT item, score AS bs FROM s WHERE run = 'view')
SELECT run, count(*) AS n_items,
       round(avg(CASE WHEN score > bs THEN 1.0 WHEN score = bs THEN 0.5 ELSE 0.0 END), 6) AS win_rate
FROM s JOIN b ON s.item = b.item WHERE run <> 'view' GROUP BY run""")
def win_rate(spark, sf_dir):
    """Win rate of each run against the baseline run over shared items."""
    w = EV.win_rate(_run_scores(spark, sf_dir), "view")
    return w.select("run", "n_items", F.round("win_rate", 6).alias("win_rate"))


@query("run_rank", """
SELECT run, round(mean_score, 6) AS mean_score, CAST(dense_rank() OVER (ORDER BY mean_score DESC) AS INTEGER) AS rank
FROM (SELECT event_type AS run, avg(value) AS mean_score FROM events GROUP BY 1)""")
def run_rank(spark, sf_dir):
    """Leaderboard rank of runs by mean score."""
    ev = table(spark, sf_dir, "events")
    means = ev.groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("mean_score"))
    r = EV.rank_runs(means)
    return r.select("run", F.round("mean_score", 6).alias("mean_score"), "rank")


def _mean_rollup_sql(scale: str) -> str:
    return f"""
WITH s AS ({S.STEPS}), e AS (SELECT run, max(step) AS last_step FROM s GROUP BY 1),
w AS (SELECT run, (step - 1) // 10 AS log_window, avg(loss * {scale}) AS avg_loss FROM s GROUP BY 1, 2)
SELECT w.run, CAST(log_window AS BIGINT) AS log_window, (log_window + 1) * 10 AS step, round(avg_loss, 6) AS avg_loss
FROM w JOIN e ON w.run = e.run WHERE (log_window + 1) * 10 <= last_step"""


@query("log_rollup_sft", _mean_rollup_sql("1.0"))
def log_rollup_sft(spark, sf_dir):
    """Supervised-training log: mean loss of each run every 10 steps."""
    r = EV.rollup_mean(I.steps(spark, sf_dir), "loss")
    return r.select("run", "log_window", "step", F.round("avg_loss", 6).alias("avg_loss"))


@query("log_rollup_rm", _mean_rollup_sql("(1.0 / 16)"))
def log_rollup_rm(spark, sf_dir):
    """Reward-model log: loss already divided by 16 accumulation steps."""
    r = EV.rollup_mean(I.steps(spark, sf_dir), "loss", scale=1.0 / 16)
    return r.select("run", "log_window", "step", F.round("avg_loss", 6).alias("avg_loss"))


@query("log_rollup_pref", f"""
WITH s AS ({S.STEPS}), e AS (SELECT run, max(step) AS last_step FROM s GROUP BY 1),
w AS (SELECT run, (step - 1) // 10 AS log_window, count(*) AS n, sum(loss) AS l, sum(reward_acc) AS a, sum(reward_diff) AS d,
             sum(chosen_ratio) AS c, sum(rejected_ratio) AS r FROM s GROUP BY 1, 2),
cw AS (SELECT w.*, last_step, (log_window + 1) * 10 <= last_step AS f,
              sum(c) OVER (PARTITION BY w.run ORDER BY log_window ROWS UNBOUNDED PRECEDING) AS cc,
              sum(r) OVER (PARTITION BY w.run ORDER BY log_window ROWS UNBOUNDED PRECEDING) AS rc FROM w JOIN e ON w.run = e.run)
SELECT run, CAST(log_window AS BIGINT) AS log_window, CASE WHEN f THEN (log_window + 1) * 10 ELSE last_step END AS step,
       round(l / n, 6) AS loss, CASE WHEN f THEN round(a / n, 6) END AS reward_acc, CASE WHEN f THEN round(d / n, 6) END AS reward_diff,
       CASE WHEN f THEN round(cc / 10, 6) END AS chosen_ratio, CASE WHEN f THEN round(rc / 10, 6) END AS rejected_ratio,
       CASE WHEN f THEN round(c / n, 6) END AS chosen_ratio_window,
       CASE WHEN f THEN round(r / n, 6) END AS rejected_ratio_window, NOT f AS is_final
FROM cw""")
def log_rollup_pref(spark, sf_dir):
    """Preference-training log with the never-reset ratio sums kept as-is."""
    r = EV.rollup_preference(I.steps(spark, sf_dir))
    cols = ["loss", "reward_acc", "reward_diff", "chosen_ratio", "rejected_ratio",
            "chosen_ratio_window", "rejected_ratio_window"]
    return r.select("run", "log_window", "step", *_r6(*cols), "is_final")


@query("log_rollup_rl", f"""
WITH a AS ({LOO_SQL}),
pl AS (SELECT prompt_id, -avg(advantage * seq_lp) AS loss FROM a GROUP BY 1),
c AS (SELECT prompt_id, sample_idx // 2 AS chunk, avg(reward) AS cm FROM a GROUP BY 1, 2),
ps AS (SELECT prompt_id, sum(cm) AS rs, avg(cm) AS rm FROM c GROUP BY 1),
s AS (SELECT ps.prompt_id, rs, rm, loss, ps.prompt_id // 10 AS log_window FROM ps JOIN pl ON ps.prompt_id = pl.prompt_id),
w AS (SELECT log_window, avg(loss / 16) AS avg_loss, avg(rs) AS avg_reward, avg(rm) AS mean_reward FROM s GROUP BY 1)
SELECT CAST(log_window AS BIGINT) AS log_window, (log_window + 1) * 10 AS step, round(avg_loss, 6) AS avg_loss,
       round(avg_reward, 6) AS avg_reward, round(mean_reward, 6) AS mean_reward FROM w
WHERE (log_window + 1) * 10 - 1 <= (SELECT max(prompt_id) FROM s)""")
def log_rollup_rl(spark, sf_dir):
    """RL log: loss / accumulation and the chunk-summed reward per 10 steps (G7d)."""
    out = EV.rollup_rl(LS.loo_prompts(EN.samples_per_prompt(I.rollouts(spark, sf_dir))))
    return out.select("log_window", "step", *_r6("avg_loss", "avg_reward", "mean_reward"))

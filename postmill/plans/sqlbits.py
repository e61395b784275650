"""SQL fragments shared by the DuckDB oracle strings (same semantics as the
Spark column functions)."""

from postmill.functions.text import CHARSET_CLASS, PY_WS

WS = PY_WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(string_split({x}, ' ')) AS INTEGER)"


def charset(x: str) -> str:
    cls = CHARSET_CLASS.replace("'", "''")
    return f"regexp_full_match({x}, '[{cls}]*')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, '[{WS}]*')"


def first_turns() -> str:
    return ("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text, "
            "arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text "
            "FROM conversations GROUP BY conv_id")


def py_list(x: str) -> str:
    return f"('[' || array_to_string({x}, ', ') || ']')"


CANDIDATES = ("SELECT conv_id, turn, text, CAST((length(text) * 7 + turn * 3) % 11 AS DOUBLE) AS score "
              "FROM conversations WHERE role = 'assistant'")

PROMPTS = ("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt "
           "FROM conversations GROUP BY conv_id HAVING prompt IS NOT NULL")

TASKS = """SELECT task_id, CASE WHEN task_id % 2 = 1 THEN [n1, n2, n3, n4] ELSE [n1, n2, n3] END AS nums,
       CAST(CASE WHEN task_id % 4 < 2 THEN abs(n1 + n2 - n3 - CASE WHEN task_id % 2 = 1 THEN n4 ELSE 0 END)
            ELSE (task_id * 17 + 3) % 100 END AS INTEGER) AS target,
       n1, n2, n3, CASE WHEN task_id % 2 = 1 THEN n4 END AS n4
FROM (SELECT o_orderkey AS task_id,
             CAST(1 + (o_orderkey * 7 + (o_orderkey // 99) * 5 + (o_orderkey // 9801) * 3 + 3) % 99 AS INTEGER) AS n1,
             CAST(1 + (o_orderkey * 13 + (o_orderkey // 99) * 17 + (o_orderkey // 9801) * 7 + 5) % 99 AS INTEGER) AS n2,
             CAST(1 + (o_orderkey * 29 + (o_orderkey // 99) * 31 + (o_orderkey // 9801) * 19 + 11) % 99 AS INTEGER) AS n3,
             CAST(1 + (o_orderkey * 41 + (o_orderkey // 99) * 2 + (o_orderkey // 9801) * 37 + 17) % 99 AS INTEGER) AS n4
      FROM orders)"""

# Correct-equation text and its value, as built by inputs.answers.
EQ_TEXT = """CASE WHEN n1 + n2 >= n3 + coalesce(n4, 0)
     THEN CASE WHEN n4 IS NULL THEN n1 || ' + ' || n2 || ' - ' || n3 ELSE n1 || ' + ' || n2 || ' - ' || n3 || ' - ' || n4 END
     ELSE CASE WHEN n4 IS NULL THEN n3 || ' - ' || n1 || ' - ' || n2 ELSE n3 || ' + ' || n4 || ' - ' || n1 || ' - ' || n2 END END"""
EQ_VALUE = "CAST(abs(n1 + n2 - n3 - coalesce(n4, 0)) AS DOUBLE)"

ANSWERS = f"""SELECT task_id, nums, target, n1, n2, n3, n4, task_id % 6 AS form, {EQ_TEXT} AS eq,
  CASE task_id % 6
    WHEN 0 THEN '<think>add and subtract</think>' || chr(10) || '<answer>' || ({EQ_TEXT}) || '</answer>'
    WHEN 1 THEN '<answer>' || n1 || ' + ' || n1 || '</answer>'
    WHEN 2 THEN '<answer>' || array_to_string(nums, ' * ') || '</answer>'
    WHEN 3 THEN 'I think it is ' || ({EQ_TEXT})
    WHEN 4 THEN '<answer>1</answer> <answer>' || ({EQ_TEXT}) || '</answer>'
    ELSE '<answer>' || ({EQ_TEXT}) || '</answer>' || chr(10) || 'Done.' END AS response
FROM ({TASKS})"""

# Expected score of each answer form, computed from the construction.
ANSWER_SCORE = f"""CAST(CASE form
    WHEN 0 THEN CASE WHEN abs({EQ_VALUE} - target) < 1e-5 THEN 1.0 ELSE 0.1 END
    WHEN 4 THEN CASE WHEN abs({EQ_VALUE} - target) < 1e-5 THEN 1.0 ELSE 0.1 END
    WHEN 2 THEN CASE WHEN abs(CAST(n1 AS DOUBLE) * n2 * n3 * coalesce(n4, 1) - target) < 1e-5 THEN 1.0 ELSE 0.1 END
    WHEN 1 THEN 0.1
    ELSE 0.0 END AS DOUBLE)"""

LOGPROBS = """SELECT vec_id, label, label + 8 AS prompt_len, label AS n_pad,
       list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS lp,
       list_reverse(list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)))) AS lp_ref
FROM embeddings"""

ROLLOUTS = """SELECT event_id, CAST(floor(event_id / 16) AS BIGINT) AS prompt_id, event_id % 16 AS sample_idx,
       ln(1 + value) AS reward, -(user_id % 17) / CAST(4 AS DOUBLE) AS seq_lp FROM events"""

STEPS = """SELECT event_type AS run, event_id + 1 AS step, ln(1 + value) AS loss,
       CAST(CASE WHEN value > 250 THEN 1 ELSE 0 END AS DOUBLE) AS reward_acc, (value - 250) / 97.0 AS reward_diff,
       value / 89.0 AS chosen_ratio, -value / 83.0 AS rejected_ratio FROM events"""

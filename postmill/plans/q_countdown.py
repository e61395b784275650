"""Countdown queries: prompts, answer search, extraction, validation, scoring
(B11-B15, B18, C8, D1-D11, E2, E3)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.answer import evaluate, extract_solution, score_answers, validate_equation
from postmill.functions.text import py_strip
from postmill.operators import countdown as CD
from postmill.operators.sample import first_n, last_n
from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query

NL = "chr(10)"


def _prompt_sql(body: str) -> str:
    return f"('{K.IM_START}user' || {NL} || {body} || ' {K.IM_END}' || {NL} || '{K.IM_START}assistant' || {NL})"


def _fill_sql(template: str, answer: str = "") -> str:
    values = {"nums": S.py_list("nums"), "target": "target", "answer": answer}
    return " || ".join(values[part] if k % 2 else "'" + part.replace("'", "''") + "'"
                       for k, part in enumerate(re.split(r"\{(\w+)\}", template)))


@query("countdown_prompts", f"""
SELECT task_id, {_prompt_sql(_fill_sql(K.CD_INTRO + K.CD_RULES))} AS prompt,
       target AS gt_target, array_to_string(nums, ',') AS gt_numbers
FROM ({S.TASKS})""")
def countdown_prompts(spark, sf_dir):
    """Base prompt and ground-truth struct per task."""
    t = I.tasks(spark, sf_dir).select("task_id", CD.countdown_prompt().alias("prompt"),
                                       CD.ground_truth().alias("gt"))
    return t.select("task_id", "prompt", F.col("gt.target").alias("gt_target"),
                    F.array_join("gt.numbers", ",").alias("gt_numbers"))


# ---- answer search oracle (written per tree shape, independent of the template builder) ----

def _f(o: str, x: str, y: str) -> str:
    return f"(CASE {o} WHEN 0 THEN {x} + {y} WHEN 1 THEN {x} - {y} WHEN 2 THEN {x} * {y} ELSE {x} / nullif({y}, 0) END)"


def _s(o: str) -> str:
    return f"(['+', '-', '*', '/'])[{o} + 1]"


def _perm_sql(n: int) -> str:
    cols = [f"q{i}" for i in range(1, n + 1)]
    frm = ", ".join(f"range({n}) r{i}(q{i})" for i in range(1, n + 1))
    distinct = " AND ".join(f"q{i} <> q{j}" for i in range(1, n + 1) for j in range(i + 1, n + 1))
    return (f"SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {', '.join(cols)}) - 1 AS pi "
            f"FROM {frm} WHERE {distinct}")


def _sum_sql(t) -> str:
    return f"({_plain_sql(t[1])} || {_signed_sql(t[2], f'{t[0]} = 1')})"


def _product_sql(t) -> str:
    o, left, right = t
    second = _term_sql(right)
    if isinstance(right, tuple):
        second = f"CASE WHEN {o} = 3 AND {right[0]} >= 2 THEN '(' || {second} || ')' ELSE {second} END"
    return f"({_term_sql(left)} || CASE {o} WHEN 2 THEN ' * ' ELSE ' / ' END || {second})"


def _term_sql(t) -> str:
    """A part of a product: a sum stands in parentheses."""
    if not isinstance(t, tuple):
        return f"CAST(i{t} AS VARCHAR)"
    return f"CASE WHEN {t[0]} < 2 THEN '(' || {_sum_sql(t)} || ')' ELSE {_product_sql(t)} END"


def _signed_sql(t, minus: str) -> str:
    """Terms after the first of a sum, signs carried through its parts."""
    whole = f"(CASE WHEN {minus} THEN ' - ' ELSE ' + ' END || {_term_sql(t)})"
    if not isinstance(t, tuple):
        return whole
    return f"CASE WHEN {t[0]} < 2 THEN {_signed_sql(t[1], minus)} || {_signed_sql(t[2], f'(({minus}) <> ({t[0]} = 1))')} ELSE {whole} END"


def _plain_sql(t) -> str:
    """The text with the fewest parentheses, for a tree shape of operator columns and leaves."""
    if not isinstance(t, tuple):
        return _term_sql(t)
    return f"CASE WHEN {t[0]} < 2 THEN {_sum_sql(t)} ELSE {_product_sql(t)} END"


def _branch(n, per, ord_expr, text, value, nops, shape):
    ops = ", ".join(f"range(4) x{i}(o{i})" for i in range(1, nops + 1))
    return (f"SELECT nums, target, pi * {per} + {ord_expr} AS ord, {text} AS expr, {_plain_sql(shape)} AS plain "
            f"FROM k{n}, {ops} WHERE abs({value} - target) < 1e-5")


def _hits_sql() -> str:
    """CTEs up to ``hits``: every candidate that hits its key's target."""
    a, b, c, d = "a", "b", "c", "d"
    sa, sb, sc, sd = "CAST(ia AS VARCHAR)", "CAST(ib AS VARCHAR)", "CAST(ic AS VARCHAR)", "CAST(id AS VARCHAR)"
    s1, s2, s3 = _s("o1"), _s("o2"), _s("o3")
    br3 = [
        _branch(3, 32, "o1 * 4 + o2", f"'(' || {sa} || ' ' || {s2} || ' (' || {sb} || ' ' || {s1} || ' ' || {sc} || '))'",
                _f("o2", a, _f("o1", b, c)), 2, ("o2", "a", ("o1", "b", "c"))),
        _branch(3, 32, "16 + o1 * 4 + o2", f"'((' || {sa} || ' ' || {s1} || ' ' || {sb} || ') ' || {s2} || ' ' || {sc} || ')'",
                _f("o2", _f("o1", a, b), c), 2, ("o2", ("o1", "a", "b"), "c")),
    ]
    br4 = [
        _branch(4, 320, "(o1 * 4 + o2) * 4 + o3",
                f"'(' || {sa} || ' ' || {s3} || ' (' || {sb} || ' ' || {s2} || ' (' || {sc} || ' ' || {s1} || ' ' || {sd} || ')))'",
                _f("o3", a, _f("o2", b, _f("o1", c, d))), 3, ("o3", "a", ("o2", "b", ("o1", "c", "d")))),
        _branch(4, 320, "(16 + o1 * 4 + o2) * 4 + o3",
                f"'(' || {sa} || ' ' || {s3} || ' ((' || {sb} || ' ' || {s1} || ' ' || {sc} || ') ' || {s2} || ' ' || {sd} || '))'",
                _f("o3", a, _f("o2", _f("o1", b, c), d)), 3, ("o3", "a", ("o2", ("o1", "b", "c"), "d"))),
        _branch(4, 320, "128 + (o1 * 4 + o2) * 4 + o3",
                f"'((' || {sa} || ' ' || {s1} || ' ' || {sb} || ') ' || {s3} || ' (' || {sc} || ' ' || {s2} || ' ' || {sd} || '))'",
                _f("o3", _f("o1", a, b), _f("o2", c, d)), 3, ("o3", ("o1", "a", "b"), ("o2", "c", "d"))),
        _branch(4, 320, "192 + (o1 * 4 + o2) * 4 + o3",
                f"'((' || {sa} || ' ' || {s2} || ' (' || {sb} || ' ' || {s1} || ' ' || {sc} || ')) ' || {s3} || ' ' || {sd} || ')'",
                _f("o3", _f("o2", a, _f("o1", b, c)), d), 3, ("o3", ("o2", "a", ("o1", "b", "c")), "d")),
        _branch(4, 320, "192 + (16 + o1 * 4 + o2) * 4 + o3",
                f"'(((' || {sa} || ' ' || {s1} || ' ' || {sb} || ') ' || {s2} || ' ' || {sc} || ') ' || {s3} || ' ' || {sd} || ')'",
                _f("o3", _f("o2", _f("o1", a, b), c), d), 3, ("o3", ("o2", ("o1", "a", "b"), "c"), "d")),
    ]
    def kn(n):
        leaves = ", ".join(f"nums[q{i} + 1] AS i{x}, CAST(nums[q{i} + 1] AS DOUBLE) AS {x}"
                           for i, x in zip(range(1, n + 1), "abcd"))
        return f"SELECT k.nums, k.target, pi, {leaves} FROM k JOIN ({_perm_sql(n)}) p ON len(k.nums) = {n}"
    hits = " UNION ALL ".join(br3 + br4)
    return f"""
WITH t AS ({S.TASKS}),
k AS (SELECT DISTINCT nums, target FROM t),
k3 AS ({kn(3)}),
k4 AS ({kn(4)}),
hits AS ({hits})"""


def _solve_sql() -> str:
    return f"""{_hits_sql()},
best AS (SELECT nums, target, arg_min(expr, ord) AS expr FROM hits GROUP BY nums, target)
SELECT t.task_id, coalesce(best.expr, '') AS answer_raw, best.expr IS NOT NULL AS solved
FROM t LEFT JOIN best ON t.nums = best.nums AND t.target = best.target"""


SOLVE_SQL = _solve_sql()


@query("countdown_solve", SOLVE_SQL)
def countdown_solve(spark, sf_dir):
    """First expression in the reference's enumeration order that hits the
    target; '' when none (D6, D9, D10)."""
    return CD.solve(I.tasks(spark, sf_dir)).select("task_id", "answer_raw", "solved")


@query("countdown_hint_prompts", f"""
WITH s AS ({SOLVE_SQL}), t AS ({S.TASKS})
SELECT t.task_id, {_prompt_sql(_fill_sql(K.CD_INTRO + K.CD_HINT_MIDDLE + K.CD_RULES, 's.answer_raw'))} AS prompt
FROM t JOIN s ON t.task_id = s.task_id""")
def countdown_hint_prompts(spark, sf_dir):
    """Prompt with the unsimplified search answer in the middle."""
    s = CD.solve(I.tasks(spark, sf_dir))
    return s.select("task_id", CD.countdown_prompt(hint="middle", answer="answer_raw").alias("prompt"))


@query("countdown_solution_count", f"""{_hits_sql()},
n AS (SELECT nums, target, count(*) AS n FROM hits GROUP BY nums, target)
SELECT t.task_id, coalesce(n.n, 0) AS n_solutions FROM t LEFT JOIN n ON t.nums = n.nums AND t.target = n.target""")
def countdown_solution_count(spark, sf_dir):
    """How many candidates of the enumeration hit the target."""
    return CD.count_solutions(I.tasks(spark, sf_dir)).select("task_id", "n_solutions")


@query("countdown_simplified", f"""{_hits_sql()},
best AS (SELECT nums, target, arg_min(plain, ord) AS plain FROM hits GROUP BY nums, target),
s AS (SELECT t.task_id, t.nums, t.target, coalesce(best.plain, '') AS answer, best.plain IS NOT NULL AS solved
      FROM t LEFT JOIN best ON t.nums = best.nums AND t.target = best.target)
SELECT task_id, answer, CASE WHEN solved THEN true END AS answer_verified, true AS raw_balanced,
       {_prompt_sql(_fill_sql(K.CD_INTRO + K.CD_RULES + K.CD_HINT_END, 'answer'))} AS prompt_end,
       {_fill_sql(K.CD_TEACHER, 'answer')} AS teacher_user FROM s""")
def countdown_simplified(spark, sf_dir):
    """Simplified answers, their re-check, balance flag, the answer-at-the-end
    prompt and the teacher request (D7, D8, D11, B12, B14). The oracle writes each tree
    shape's text with the fewest parentheses as a column expression."""
    s = CD.verify(CD.solve(I.tasks(spark, sf_dir)))
    return s.select("task_id", "answer", "answer_verified",
                    CD.balanced(F.col("answer_raw")).alias("raw_balanced"),
                    CD.countdown_prompt(hint="end", answer="answer").alias("prompt_end"),
                    F.get(CD.teacher_messages(), 1)["content"].alias("teacher_user"))


def _scored(spark, sf_dir):
    return score_answers(I.answers(spark, sf_dir), "response", "nums", "target")


@query("answer_extract", f"""
WITH a AS ({S.ANSWERS}),
b AS (SELECT task_id, CASE WHEN strpos('Assistant: ' || response, 'Assistant:') > 0
        THEN substr('Assistant: ' || response, strpos('Assistant: ' || response, 'Assistant:') + 10) END AS body FROM a),
l AS (SELECT task_id, string_split(body, {NL})[-1] AS line FROM b)
SELECT task_id, {S.strip("regexp_extract_all(line, '<answer>(.*?)</answer>', 1)[-1]")} AS equation FROM l""")
def answer_extract(spark, sf_dir):
    """Last ``<answer>`` tag on the last line after the marker."""
    a = I.answers(spark, sf_dir)
    return a.select("task_id", extract_solution(F.concat(F.lit("Assistant: "), F.col("response"))).alias("equation"))


@query("answer_validate", f"""
WITH a AS ({S.ANSWERS}),
l AS (SELECT task_id, nums, string_split('Assistant: ' || response, {NL})[-1] AS line FROM a),
e AS (SELECT task_id, nums, {S.strip("regexp_extract_all(line, '<answer>(.*?)</answer>', 1)[-1]")} AS equation FROM l)
SELECT task_id, coalesce(equation IS NOT NULL AND
         list_sort(list_transform(regexp_extract_all(equation, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)))
         = list_sort(list_transform(nums, lambda x: CAST(x AS BIGINT))), false) AS valid
FROM e""")
def answer_validate(spark, sf_dir):
    """Numbers in the equation equal the task numbers as a multiset."""
    a = I.answers(spark, sf_dir).withColumn(
        "equation", extract_solution(F.concat(F.lit("Assistant: "), F.col("response"))))
    return a.select("task_id", F.coalesce(F.col("equation").isNotNull() & validate_equation("equation", "nums"),
                                          F.lit(False)).alias("valid"))


@query("answer_score", f"""
WITH a AS ({S.ANSWERS})
SELECT task_id, {S.ANSWER_SCORE} AS score,
       CASE WHEN form IN (0, 4) THEN round({S.EQ_VALUE}, 6)
            WHEN form = 2 THEN round(CAST(n1 AS DOUBLE) * n2 * n3 * coalesce(n4, 1), 6) END AS value
FROM a""")
def answer_score(spark, sf_dir):
    """Countdown reward 0 / 0.1 / 1.0 with the native evaluator."""
    return _scored(spark, sf_dir).select("task_id", "score", F.round("value", 6).alias("value"))


@query("rl_rewards", f"""
WITH a AS ({S.ANSWERS})
SELECT task_id, {S.ANSWER_SCORE} AS reward FROM a""")
def rl_rewards(spark, sf_dir):
    """RL reward: the decoded text is prompt + response; the prompt prefix is
    cut by length, ``Assistant: `` prepended, stripped, then scored (B18, D4)."""
    a = I.answers(spark, sf_dir).withColumn("prompt", CD.countdown_prompt())
    cut = F.expr("substring(concat(prompt, response), length(prompt) + 1)")
    a = a.withColumn("solution", py_strip(F.concat(F.lit("Assistant: "), cut))).drop("prompt")
    return score_answers(a, "solution", "nums", "target", prefix=False, out="reward").select("task_id", "reward")


@query("verified_responses", f"""
WITH a AS ({S.ANSWERS}), s AS (SELECT task_id, {S.ANSWER_SCORE} AS score FROM a)
SELECT task_id, score FROM s WHERE score >= {K.VERIFIED_MIN_SCORE} ORDER BY task_id LIMIT {K.VERIFIED_TAKE}""")
def verified_responses(spark, sf_dir):
    """Keep responses scoring >= 0.9, the first 1,500 by task id."""
    s = _scored(spark, sf_dir).select("task_id", "score")
    return first_n(s, K.VERIFIED_TAKE, "task_id", where=F.col("score") >= K.VERIFIED_MIN_SCORE)


@query("last_n_tasks", f"""
SELECT task_id, {_prompt_sql(_fill_sql(K.CD_INTRO + K.CD_RULES))} AS prompt
FROM ({S.TASKS}) ORDER BY task_id DESC LIMIT {K.EVAL_LAST_N}""")
def last_n_tasks(spark, sf_dir):
    """Evaluation slice: the last 2,000 tasks by id, with prompts."""
    t = last_n(I.tasks(spark, sf_dir), K.EVAL_LAST_N, "task_id")
    return t.select("task_id", CD.countdown_prompt().alias("prompt"))


# Arithmetic forms by task_id % 12: (text in Spark and SQL pieces, value in SQL).
ARITHMETIC = (
    ("({a} + {b}) * {c}", "(a + b) * c"), ("{a} / {b}", "a / b"), ("{a} // {b}", "floor(a / b)"), ("{a} ** 2", "a * a"),
    ("-{a} + {b}", "b - a"), ("{a}.25 - {b} * .5", "a + 0.25 - b * 0.5"), ("05 + {a}", None), ("{a} / ({b} - {b})", None),
    ("{a} - ({b} - ({c} / 4))", "a - (b - c / 4)"), ("2 ** -1 * {a}", "a / 2"), ("{a} // -{b}", "floor(a / -b)"), ("(({a}) + {b}", None),
)


def _arithmetic_sql() -> str:
    text = " ".join(f"WHEN {k} THEN " + " || ".join(f"'{p}'" if i % 2 == 0 else f"CAST({p} AS VARCHAR)" for i, p in enumerate(_pieces(t)))
                    for k, (t, _) in enumerate(ARITHMETIC))
    value = " ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, (_, v) in enumerate(ARITHMETIC))
    return f"""WITH t AS (SELECT task_id, n1, n2, n3, CAST(n1 AS DOUBLE) AS a, CAST(n2 AS DOUBLE) AS b, CAST(n3 AS DOUBLE) AS c FROM ({S.TASKS}))
SELECT task_id, CASE task_id % {len(ARITHMETIC)} {text} END AS equation,
       round(CAST(CASE task_id % {len(ARITHMETIC)} {value} END AS DOUBLE), 6) AS value FROM t"""


def _pieces(form: str) -> list[str]:
    """Literal and number-column pieces in turn."""
    return re.split(r"\{(n\d)\}", form.replace("{a}", "{n1}").replace("{b}", "{n2}").replace("{c}", "{n3}"))


@query("answer_arithmetic", _arithmetic_sql())
def answer_arithmetic(spark, sf_dir):
    """The evaluator on parentheses, every operator, unary signs, decimals, leading zeros,
    division by zero and unbalanced text (D3); the oracle computes from the numbers."""
    t = I.tasks(spark, sf_dir)
    form = F.col("task_id") % len(ARITHMETIC)
    number = {f"n{i}": F.element_at("nums", i).cast("string") for i in (1, 2, 3)}
    equation = F.coalesce(*[F.when(form == k, F.concat(*[number.get(p, F.lit(p)) for p in _pieces(text)]))
                            for k, (text, _) in enumerate(ARITHMETIC)])
    t = t.select("task_id", equation.alias("equation"))
    return t.select("task_id", "equation", F.round(evaluate("equation"), 6).alias("value"))

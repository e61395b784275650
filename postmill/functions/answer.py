"""Answer extraction, validation, native equation evaluation and scoring.

``evaluate`` is an operator-precedence (shunting-yard) evaluator written as a
Spark higher-order ``aggregate`` over regex tokens: no Python UDF and no
``eval``. It follows Python's arithmetic grammar for the characters the
reference admits (digits, ``+ - * / ( ) .`` and whitespace): ``**`` (right
associative, binds tighter than a unary sign on its left), ``//`` (floor
division), unary signs, decimals. Anything Python would reject (juxtaposed
operands, ``05``, unbalanced or empty parentheses, division by zero, complex
results) yields NULL. Values are doubles; Python's unbounded ints become
+/-inf past 1.8e308 and lose exactness past 2**53.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions.text import PY_WS, after_first, last_line, py_strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- D1 ----------------------------------------------------------------------

def extract_solution(text) -> Column:
    """Text after the first ``Assistant:`` (else after the first chat assistant
    header), last line only, last ``<answer>...</answer>`` there, stripped;
    NULL when there is no marker or no tag."""
    t = _c(text)
    body = F.when(F.instr(t, K.ASSISTANT_MARK) > 0, after_first(t, K.ASSISTANT_MARK)) \
            .when(F.instr(t, K.ASSISTANT_MARK_CHAT) > 0, after_first(t, K.ASSISTANT_MARK_CHAT))
    tags = F.regexp_extract_all(last_line(body), F.lit("(?s)" + K.ANSWER_TAG_PATTERN), F.lit(1))
    return py_strip(F.try_element_at(tags, F.lit(-1)))


# ---- D2 ----------------------------------------------------------------------

def validate_equation(eq, nums) -> Column:
    """Multiset of integers in ``eq`` equals the multiset ``nums``."""
    found = F.transform(F.regexp_extract_all(_c(eq), F.lit(f"({K.NUMBER_PATTERN})"), F.lit(1)),
                        lambda x: x.try_cast("bigint"))
    want = F.transform(_c(nums), lambda x: x.cast("bigint"))
    return F.coalesce(F.array_sort(found) == F.array_sort(want), F.lit(False))


# ---- D3 ----------------------------------------------------------------------

_TOKEN_RE = "([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+|[*][*]|//|[-+*/()])"

_PREC = ("CASE {x} WHEN '+' THEN 1 WHEN '-' THEN 1 WHEN '*' THEN 2 WHEN '/' THEN 2 WHEN '//' THEN 2 "
         "WHEN 'u+' THEN 3 WHEN 'u-' THEN 3 WHEN '**' THEN 4 ELSE 0 END")


def _prec(x: str) -> str:
    return _PREC.format(x=x)


def _binop(op: str, a: str, b: str) -> str:
    floordiv = (f"transform(array(try_mod({a}, {b})), m -> transform(array(((({a}) - m) / ({b})) - "
                f"CASE WHEN m != 0 AND (({b}) < 0) != (m < 0) THEN 1.0D ELSE 0.0D END), "
                f"dv -> CASE WHEN dv - floor(dv) > 0.5D THEN floor(dv) + 1.0D ELSE CAST(floor(dv) AS DOUBLE) END)[0])[0]")
    power = (f"CASE WHEN ({a}) = 0 AND ({b}) < 0 THEN NULL ELSE "
             f"transform(array(power({a}, {b})), pw -> CASE WHEN isnan(pw) THEN NULL ELSE pw END)[0] END")
    return (f"CASE {op} WHEN '+' THEN ({a}) + ({b}) WHEN '-' THEN ({a}) - ({b}) WHEN '*' THEN ({a}) * ({b}) "
            f"WHEN '/' THEN try_divide({a}, {b}) "
            f"WHEN '//' THEN CASE WHEN ({b}) = 0 THEN NULL ELSE {floordiv} END "
            f"WHEN '**' THEN {power} END")


def _apply_top(st: str) -> str:
    """Pop the top operator of ``st.o`` and apply it to ``st.v``; returns the
    struct (v, o, e, d)."""
    op = f"element_at({st}.o, -1)"
    n = f"size({st}.v)"
    unary = (f"named_struct('v', concat(slice({st}.v, 1, {n} - 1), array(CASE WHEN {op} = 'u-' "
             f"THEN -element_at({st}.v, -1) ELSE element_at({st}.v, -1) END)), "
             f"'o', slice({st}.o, 1, size({st}.o) - 1), 'e', false, 'd', false)")
    binary = (f"transform(array({_binop(op, f'element_at({st}.v, -2)', f'element_at({st}.v, -1)')}), r -> "
              f"named_struct('v', concat(slice({st}.v, 1, {n} - 2), array(r)), "
              f"'o', slice({st}.o, 1, size({st}.o) - 1), 'e', r IS NULL, 'd', false))[0]")
    return (f"CASE WHEN {op} IN ('u+', 'u-') THEN CASE WHEN {n} < 1 THEN {_err4(st)} ELSE {unary} END "
            f"ELSE CASE WHEN {n} < 2 THEN {_err4(st)} ELSE {binary} END END")


def _err4(st: str) -> str:
    return f"named_struct('v', {st}.v, 'o', {st}.o, 'e', true, 'd', true)"


def _pop_while(s: str, cond: str) -> str:
    """Repeatedly apply the top operator while ``cond`` (over ``top``) holds.
    Returns struct(v, o, e, d). The loop is skipped outright when the stack is
    empty or its top does not pop (the common case)."""
    c = cond.format(top="element_at(st.o, -1)")
    c_first = cond.format(top=f"element_at({s}.o, -1)")
    loop = (f"aggregate(sequence(1, size({s}.o)), "
            f"named_struct('v', {s}.v, 'o', {s}.o, 'e', {s}.e, 'd', false), "
            f"(st, i) -> CASE WHEN st.d OR st.e OR size(st.o) = 0 OR NOT ({c}) "
            f"THEN named_struct('v', st.v, 'o', st.o, 'e', st.e, 'd', true) "
            f"ELSE {_apply_top('st')} END)")
    return (f"CASE WHEN {s}.e OR size({s}.o) = 0 OR NOT ({c_first}) "
            f"THEN named_struct('v', {s}.v, 'o', {s}.o, 'e', {s}.e, 'd', true) ELSE {loop} END")


def _state(v: str, o: str, p: str, e: str) -> str:
    return f"named_struct('v', {v}, 'o', {o}, 'p', {p}, 'e', {e})"


def _err(s: str) -> str:
    return _state(f"{s}.v", f"{s}.o", f"{s}.p", "true")


def _step(s: str, t: str) -> str:
    operand_before = f"{s}.p IN ('num', 'close')"
    leading_zero = f"(left({t}, 1) = '0' AND instr({t}, '.') = 0 AND TRIM(LEADING '0' FROM {t}) != '')"
    number = (f"CASE WHEN {operand_before} OR {leading_zero} THEN {_err(s)} "
              f"ELSE {_state(f'concat({s}.v, array(CAST({t} AS DOUBLE)))', f'{s}.o', chr(39) + 'num' + chr(39), 'false')} END")
    open_p = (f"CASE WHEN {operand_before} THEN {_err(s)} "
              f"ELSE {_state(f'{s}.v', f'concat({s}.o, array({t}))', chr(39) + 'open' + chr(39), 'false')} END")
    close_p = (f"CASE WHEN {s}.p IN ('op', 'open', 'start') THEN {_err(s)} ELSE "
               f"transform(array({_pop_while(s, chr(123) + 'top' + chr(125) + ' != ' + chr(39) + '(' + chr(39))}), q -> "
               f"CASE WHEN q.e OR size(q.o) = 0 THEN {_state('q.v', 'q.o', 'q.p', 'true').replace('q.p', s + '.p')} "
               f"ELSE {_state('q.v', 'slice(q.o, 1, size(q.o) - 1)', chr(39) + 'close' + chr(39), 'false')} END)[0] END")
    pop_cond = ("{top} != '(' AND (" + _prec("{top}") + f" > {_prec(t)} OR (" + _prec("{top}") +
                f" = {_prec(t)} AND {t} != '**'))")
    binary = (f"transform(array({_pop_while(s, pop_cond)}), q -> CASE WHEN q.e THEN "
              f"{_state('q.v', 'q.o', s + '.p', 'true')} "
              f"ELSE {_state('q.v', f'concat(q.o, array({t}))', chr(39) + 'op' + chr(39), 'false')} END)[0]")
    unary = (f"CASE WHEN {t} IN ('+', '-') THEN "
             f"{_state(f'{s}.v', f'concat({s}.o, array(concat(' + chr(39) + 'u' + chr(39) + f', {t})))', chr(39) + 'op' + chr(39), 'false')} "
             f"ELSE {_err(s)} END")
    operator = f"CASE WHEN {s}.p IN ('start', 'open', 'op') THEN {unary} ELSE {binary} END"
    return (f"CASE WHEN {s}.e THEN {s} WHEN left({t}, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '.') "
            f"THEN {number} "
            f"WHEN {t} = '(' THEN {open_p} WHEN {t} = ')' THEN {close_p} ELSE {operator} END")


def _evaluate_sql(eq: str) -> str:
    tokens = f"regexp_extract_all({eq}, '{_TOKEN_RE}', 1)"
    init = _state("CAST(array() AS ARRAY<DOUBLE>)", "CAST(array() AS ARRAY<STRING>)", "'start'", "false")
    folded = f"aggregate(tk, {init}, (s, t) -> {_step('s', 't')})"
    finish = (f"CASE WHEN f.e OR f.p IN ('op', 'open', 'start') THEN NULL ELSE "
              f"transform(array({_pop_while('f', '{top} != ' + chr(39) + '(' + chr(39))}), r -> "
              f"CASE WHEN r.e OR size(r.o) > 0 OR size(r.v) != 1 THEN NULL ELSE element_at(r.v, 1) END)[0] END")
    # Tokenised once (bound as ``tk``); every non-blank character must belong
    # to a token, otherwise the text is not an arithmetic expression.
    covered = f"array_join(tk, '') = regexp_replace({eq}, '[ \\\\t\\\\f]', '')"
    return (f"CASE WHEN {eq} RLIKE '^[0-9+*/().\\\\t\\\\f -]+$' THEN transform(array({tokens}), tk -> "
            f"CASE WHEN {covered} THEN transform(array({folded}), f -> {finish})[0] END)[0] END")


def evaluate(name: str) -> Column:
    """Value of the arithmetic expression in column ``name`` as Python would
    compute it, or NULL."""
    return F.expr(_evaluate_sql(f"`{name}`"))


# ---- D4 / D5 -----------------------------------------------------------------

def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _extract_sql(t: str) -> str:
    m1, m2 = K.ASSISTANT_MARK, K.ASSISTANT_MARK_CHAT
    body = (f"CASE WHEN instr({t}, {_sql_str(m1)}) > 0 THEN substring({t}, instr({t}, {_sql_str(m1)}) + {len(m1)}) "
            f"WHEN instr({t}, {_sql_str(m2)}) > 0 THEN substring({t}, instr({t}, {_sql_str(m2)}) + {len(m2)}) END")
    tags = (f"regexp_extract_all(substring_index({body}, {_sql_str(chr(10))}, -1), "
            f"{_sql_str('(?s)' + K.ANSWER_TAG_PATTERN)}, 1)")
    strip_re = _sql_str(rf"\A[{PY_WS}]+|[{PY_WS}]+\z")
    return f"regexp_replace(try_element_at({tags}, -1), {strip_re}, '')"


def _valid_sql(e: str, nums: str) -> str:
    return (f"coalesce(array_sort(transform(regexp_extract_all({e}, '([0-9]+)', 1), z -> try_cast(z AS BIGINT))) "
            f"= array_sort(transform({nums}, z -> CAST(z AS BIGINT))), false)")


def score_sql(text: str, nums: str, target: str, format_score: float = K.FORMAT_SCORE,
              score: float = K.CORRECT_SCORE, prefix: bool = True) -> str:
    """SQL for struct(equation, valid, value, score); every intermediate is
    bound once through a lambda, so filters pushed through it do not duplicate
    the evaluator."""
    t = f"concat('Assistant: ', {text})" if prefix else text
    fs, sc = float(format_score), float(score)
    inner = (f"transform(array(CASE WHEN __v_ok THEN {_evaluate_sql('__e')} END), __val -> named_struct("
             f"'equation', __e, 'valid', __v_ok, 'value', __val, 'score', "
             f"CASE WHEN __e IS NULL THEN 0.0D WHEN NOT __v_ok OR __val IS NULL THEN {fs}D "
             f"WHEN abs(__val - {target}) < {K.TOLERANCE} THEN {sc}D ELSE {fs}D END))[0]")
    inner = inner.replace("__v_ok", f"(__e IS NOT NULL AND {_valid_sql('__e', nums)})")
    return f"transform(array({_extract_sql(t)}), __e -> {inner})[0]"


def score_answers(df, text: str, nums: str, target: str, format_score: float = K.FORMAT_SCORE,
                  score: float = K.CORRECT_SCORE, prefix: bool = True, out: str = "score"):
    """Countdown reward (D4): adds ``equation`` (D1), ``valid`` (D2), ``value``
    (D3) and ``out``. 0 without an answer, ``format_score`` for wrong numbers,
    unevaluable or wrong value, ``score`` within 1e-5 of the target. ``prefix``
    prepends ``"Assistant: "`` as the leaderboards and RL loop do. The
    evaluator only runs on rows whose numbers are valid, like the reference.
    Evaluation happens in place: no shuffle, linear in the rows."""
    res = F.expr(score_sql(f"`{text}`", f"`{nums}`", f"`{target}`", format_score, score, prefix))
    d = df.withColumn("_res", res)
    return (d.withColumn("equation", F.col("_res.equation")).withColumn("valid", F.col("_res.valid"))
             .withColumn("value", F.col("_res.value")).withColumn(out, F.col("_res.score")).drop("_res"))


def parse_reward(reply, form: str = "last") -> Column:
    """``"name:-12.3"`` -> -12.3. ``form='last'`` takes the text after the last
    colon, ``'first'`` the text between the first and second colon."""
    parts = F.split(_c(reply), ":", -1)
    piece = F.try_element_at(parts, F.lit(-1 if form == "last" else 2))
    return py_strip(piece).try_cast("double")

"""Answer extraction / validation / evaluation / scoring."""

import math
import random

import pytest

from postmill.functions.answer import evaluate, extract_solution, parse_reward, score_answers

# Golden rows written from the scoring definition (FIXTURES.md section 2).
GOLDEN = [
    ("Assistant: <answer>3 + 5 + 8</answer>", [3, 5, 8], 16, 1.0),
    ("<answer>3 + 5 + 8</answer>", [3, 5, 8], 16, 0.0),
    ("Assistant: 3 + 5 + 8", [3, 5, 8], 16, 0.0),
    ("Assistant: <answer>3 + 5 + 8</answer>\nDone.", [3, 5, 8], 16, 0.0),
    ("Assistant: <answer>1</answer> <answer>8 + 5 + 3</answer>", [3, 5, 8], 16, 1.0),
    ("Assistant: <answer></answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>8 + 8</answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>3 * 5 + 8</answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>3 + 5 + 8 = 16</answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>(3)(5) + 8</answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>03 + 5 + 8</answer>", [3, 5, 8], 16, 0.1),
    ("Assistant: <answer>8 / (5 - 5)</answer>", [5, 5, 8], 16, 0.1),
    ("Assistant: <answer>2 ** 3</answer>", [2, 3], 8, 1.0),
    ("x <|im_start|>assistant <answer>3 + 5 + 8</answer>", [3, 5, 8], 16, 1.0),
    ("Assistant: <think>a\nb</think>\n<answer> (3 + 5) + 8 </answer>", [3, 5, 8], 16, 1.0),
]


def test_score_goldens(spark):
    df = spark.createDataFrame([(i, t, n, g) for i, (t, n, g, _) in enumerate(GOLDEN)],
                               "id int, text string, nums array<int>, target int")
    out = score_answers(df, "text", "nums", "target", prefix=False).orderBy("id").collect()
    assert [r.score for r in out] == [g[3] for g in GOLDEN]


def test_extract_marker_and_tags(spark):
    df = spark.createDataFrame([("Assistant: a\n<answer> x </answer>",), ("no marker <answer>1</answer>",),
                                ("Assistant: <answer>1</answer><answer> 2\t</answer>",)], "t string")
    got = [r.e for r in df.select(extract_solution("t").alias("e")).collect()]
    assert got == ["x", None, "2"]


def test_parse_reward_forms(spark):
    df = spark.createDataFrame([("reward:-12.5",), ("a:b:3",), ("reward: ???",)], "r string")
    got = [(r.a, r.b) for r in df.select(parse_reward("r", "last").alias("a"), parse_reward("r", "first").alias("b")).collect()]
    assert got == [(-12.5, -12.5), (3.0, None), (None, None)]


def _py(e):
    if e.count("**") > 1:
        return "skip"
    try:
        v = eval(e, {"__builtins__": None}, {})  # test oracle only
    except OverflowError:
        return "skip"
    except Exception:
        return None
    if isinstance(v, complex) or isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    if abs(v) > 1e300:
        return "skip"
    return float(v)


def _random_exprs(n, seed=7):
    rnd = random.Random(seed)
    toks = ["1", "2", "0", "7", "10", "05", "00", "3.5", ".5", "2.", "+", "-", "*", "/", "//", "**", "(", ")", " "]

    def tree(d):
        if d == 0 or rnd.random() < 0.3:
            return rnd.choice(["1", "2", "3", "7", "10", "0", "4.5", ".5"])
        op = rnd.choice(["+", "-", "*", "/", "//", "**", "+", "*"])
        left, right = tree(d - 1), tree(d - 1)
        s = f"{left} {op} {right}"
        if rnd.random() < 0.5:
            s = f"({s})"
        if rnd.random() < 0.15:
            s = rnd.choice(["-", "+", "- -"]) + s
        return s

    out = []
    for _ in range(n):
        if rnd.random() < 0.5:
            out.append("".join(rnd.choice(toks) for _ in range(rnd.randint(1, 9))))
        else:
            out.append(tree(3))
    return out


def test_evaluator_matches_python_arithmetic(spark):
    exprs = [e for e in _random_exprs(1500) if _py(e) != "skip"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, e string")
    got = {r.i: r.v for r in df.select("i", evaluate("e").alias("v")).collect()}
    bad = []
    for i, e in enumerate(exprs):
        p, s = _py(e), got[i]
        if p is None or s is None:
            ok = p is None and s is None
        else:
            ok = math.isclose(p, s, rel_tol=1e-12, abs_tol=1e-12)
        if not ok:
            bad.append((e, p, s))
    assert not bad, bad[:10]
    assert sum(v is not None for v in got.values()) > 300


@pytest.mark.parametrize("expr,value", [("2 ** -3 * 4", 0.5), ("-2**2", -4.0), ("2 ** 3 ** 2", 512.0),
                                        ("1 // 0.1", 9.0), ("-7 // 2", -4.0), ("((2))", 2.0)])
def test_evaluator_precedence(spark, expr, value):
    assert spark.createDataFrame([(expr,)], "e string").select(evaluate("e")).first()[0] == value


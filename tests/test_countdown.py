"""Answer search (D6-D11) against a brute-force search written from the definition."""

import itertools
import random
import re
from fractions import Fraction  # noqa: F401  (used by evaluated text)

import numpy as np

from pyspark.sql import functions as F

from postmill.operators import countdown as CD
from postmill.operators import values as V

OPS = ["+", "-", "*", "/"]


def _brute(nums, target):
    """Reference order: operand permutations, then split point, left, right, operator."""
    def build(seq):
        if len(seq) == 1:
            return [(str(seq[0]), float(seq[0]))]
        out = []
        for i in range(1, len(seq)):
            for ls, lv in build(seq[:i]):
                for rs, rv in build(seq[i:]):
                    for op in OPS:
                        if lv is None or rv is None:
                            v = None
                        elif op == "+":
                            v = lv + rv
                        elif op == "-":
                            v = lv - rv
                        elif op == "*":
                            v = lv * rv
                        else:
                            v = None if rv == 0 else lv / rv
                        out.append((f"({ls} {op} {rs})", v))
        return out
    for perm in itertools.permutations(nums):
        for s, v in build(list(perm)):
            if v is not None and abs(v - target) < 1e-5:
                return s
    return ""


def test_tree_numbers_follow_the_enumeration():
    for n in (1, 2, 3, 4):
        operands = tuple(range(2, 2 + n))
        trees = [CD.tree(k, operands) for k in range(CD.tree_count(n))]
        values = CD.tree_values(np.array([operands], float))[0]
        assert len(set(map(CD.full_text, trees))) == len(trees) == len(values)
        for t, v in zip(trees, values):
            assert abs(eval(CD.full_text(t)) - v) < 1e-9
    assert [CD.tree_count(n) for n in (3, 4, 5)] == [32, 320, 3584]


def _drops(text):
    """The text without each one of its pairs of parentheses in turn."""
    stack = []
    for i, ch in enumerate(text):
        if ch == "(":
            stack.append(i)
        elif ch == ")":
            j = stack.pop()
            yield text[:j] + text[j + 1:i] + text[i + 1:]


def test_simplified_text_keeps_the_value_and_needs_its_parentheses():
    # operands as powers of unlike primes tell almost all expressions apart
    for operands in ((3, 7, 11), (3, 7, 11, 19)):
        for k in range(CD.tree_count(len(operands))):
            t = CD.tree(k, operands)
            exact = lambda x: eval(re.sub(r"\d+", lambda m: f"Fraction({m[0]})", x))
            try:
                want = exact(CD.full_text(t))
            except ZeroDivisionError:
                continue
            text = CD.plain_text(t)
            assert exact(text) == want and re.findall(r"\d+", text) == [str(x) for x in operands]
            assert all(exact(x) != want for x in _drops(text))


def test_simplified_examples():
    plus, minus = ("+", 3, 5), ("-", 3, 5)
    assert CD.plain_text(("+", 15, ("/", 5, ("/", 75, 90)))) == "15 + 5 / (75 / 90)"
    assert CD.plain_text(("/", 9, ("*", 5, minus))) == "9 / (5 * (3 - 5))"
    assert CD.plain_text(("-", 8, plus)) == "8 - 3 - 5"
    assert CD.plain_text(("-", 8, minus)) == "8 - 3 + 5"
    assert CD.plain_text(("*", 8, ("/", 3, 5))) == "8 * 3 / 5"
    assert CD.plain_text(4) == "4"


def test_solve_matches_brute_force(spark):
    rnd = random.Random(3)
    tasks = [([15, 5, 75, 90], 21), ([1, 1], 50), ([88, 88, 44], 44), ([0, 97, 23], 0), ([3, 5, 8], 16)]
    for _ in range(150):
        n = rnd.choice([3, 4])
        nums = [rnd.randint(0, 99) for _ in range(n)]
        tasks.append((nums, rnd.randint(0, 99)))
    df = spark.createDataFrame([(i, t[0], t[1]) for i, t in enumerate(tasks)], "task_id long, nums array<int>, target int")
    got = {r.task_id: r for r in CD.verify(CD.solve(df)).collect()}
    for i, (nums, target) in enumerate(tasks):
        want = _brute(nums, target)
        assert got[i].answer_raw == want, (nums, target)
        assert "(" not in got[i].answer or got[i].answer_raw != got[i].answer
        assert got[i].answer_verified in (None, True)
        assert got[i].solved == bool(want)
    assert got[0].answer_raw == "(15 + (5 / (75 / 90)))"
    assert got[1].answer_raw == ""


def test_solution_scores_one(spark):
    from postmill.functions.answer import score_answers
    df = spark.createDataFrame([(1, [15, 5, 75, 90], 21), (2, [3, 5, 8], 16)], "task_id long, nums array<int>, target int")
    s = CD.solve(df).withColumn("text", F.concat(F.lit("<answer>"), "answer_raw", F.lit("</answer>")))
    assert [r.score for r in score_answers(s, "text", "nums", "target").collect()] == [1.0, 1.0]


def test_negative_null_and_empty_operands_are_unsolved(spark):
    rows = [(1, [-3, 5], 2), (2, None, 7), (3, [], 7), (4, [1, None], 1), (5, [7], None), (6, [7], 5)]
    df = spark.createDataFrame(rows, "task_id long, nums array<int>, target int")
    assert {(r.solved, r.answer, r.answer_raw) for r in CD.solve(df).collect()} == {(False, "", "")}


def test_search_runs_in_as_many_tasks_as_asked(spark):
    df = spark.createDataFrame([(i, [i % 50, i // 50 + 1, 7], i) for i in range(2000)], "task_id long, nums array<int>, target int")
    used = CD.solve(df, partitions=16)
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 16" in plan


def test_balanced(spark):
    df = spark.createDataFrame([("(1 + (2))",), (")(",), ("((",)], "s string")
    assert [r.b for r in df.select(CD.balanced("s").alias("b")).collect()] == [True, False, False]


def test_one_two_five_and_six_operands(spark):
    tasks = [(1, [3, 7, 11, 2, 5], 97), (2, [1, 1, 1, 1, 1], 100), (3, [2, 3], 5), (4, [9], 9), (5, [1, 2, 3, 4, 5, 6], 21)]
    df = spark.createDataFrame(tasks, "task_id long, nums array<int>, target int")
    got = {r.task_id: r.answer_raw for r in CD.solve(df).collect()}
    assert got == {t: _brute(n, g) for t, n, g in tasks}
    assert got[1] == "(3 + (((7 + 2) * 11) - 5))"


def test_prompts_match_literal_texts(spark):
    df = spark.createDataFrame([(1, [3, 5, 8], 16, "3 + 5 + 8", "((3 + 5) + 8)")], "task_id long, nums array<int>, target int, answer string, answer_raw string")
    row = df.select(CD.countdown_prompt().alias("base"), CD.countdown_prompt(hint="end", answer="answer").alias("end"),
                    CD.countdown_prompt(hint="middle", answer="answer_raw").alias("middle"),
                    F.get(CD.teacher_messages(), 1)["content"].alias("teacher")).first()
    rules = (" You can use basic arithmetic operations (+, -, *, /) and each number can only be used once. Show your work in "
             "<think> </think> tags. And return the final answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>")
    first = "Using the numbers [3, 5, 8], create an equation that equals 16."
    wrap = "<|im_start|>user\n{} <|im_end|>\n<|im_start|>assistant\n"
    assert row.base == wrap.format(first + rules)
    assert row.end == wrap.format(first + rules + ". The correct answer is: <answer>3 + 5 + 8</answer>.")
    assert row.middle == wrap.format(first + " Here is the answer: ((3 + 5) + 8)." + rules)
    assert row.teacher == ("Using the numbers [3, 5, 8], create an equation that equals 16, here is the answer: 3 + 5 + 8. You can use basic "
                           "arithmetic operations (+, -, *, /) and each number can only be used once. Show your thinking process in <think> "
                           "</think> tags. And return the final answer equation in <answer> </answer> tags with the format <answer> 3 + 5 + 8 </answer>")


def _all_hits(nums, target):
    """(first expression, number of hits) with every candidate evaluated."""
    first, n = None, 0
    for chunk, hit in CD.hits_by_order(nums, target):
        n += int(hit.sum())
        row = hit.any(axis=1)
        if first is None and row.any():
            k = int(row.argmax())
            first = CD.full_text(CD.tree(int(hit[k].argmax()), chunk[k]))
    return first, n


def _searched(nums, target):
    s = V.Search(nums, target, 1e-5)
    found = s.first()
    return found and CD.full_text(CD.tree(found[1], tuple(nums[i] for i in found[0]))), s.count()


def test_search_over_sets_of_operands_equals_all_candidates(monkeypatch):
    rnd = random.Random(6)
    cases = [([rnd.randint(0, 30) for _ in range(n)], rnd.choice([rnd.randint(0, 60), 10**6 + 7])) for n in (1, 2, 2, 3, 3, 3, 4, 4, 5, 6)]
    cases += [([0, 0, 0], 0), ([5, 5, 5, 5], 5), ([7], 7), ([7], 8), ([1, 0, 3, 0], 3)]
    want = [_all_hits(*c) for c in cases]
    assert [_searched(*c) for c in cases] == want
    monkeypatch.setattr(V, "TRIED", 0)         # the sets alone
    monkeypatch.setattr(V, "CANDIDATES", 100)  # in many slices, tables merged often
    assert [_searched(*c) for c in cases[:9] + cases[10:]] == want[:9] + want[10:]


LIMITED = """
import resource, sys
sys.path.insert(0, {root!r})
from postmill.operators.values import Search
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
assert Search([3, 17, 29, 41, 58, 64, 97], 10**9 + 7, 1e-5).first() is None
assert Search([3, 17, 29, 41, 58, 64, 97, 11], 77, 1e-5).first() is not None
assert Search([3, 17, 29, 41, 58, 64, 97, 11, 5], 77, 1e-5).first() is not None
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024 - base)
"""


def test_memory_of_the_search_is_bounded():
    """Seven operands without an answer (2.7 billion candidates), eight and nine with one."""
    import subprocess
    import sys

    from tests.conftest import ROOT
    out = subprocess.run([sys.executable, "-c", LIMITED.format(root=ROOT)], capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 400, out.stderr


def test_counts_and_operands_past_the_limit(spark):
    tasks = [(1, [3, 5, 8], 16), (2, [1, 1], 50), (3, [2, 2, 2, 2, 2, 2], 12), (4, None, 5), (5, [], 5), (6, [4], None), (7, [4, -4], 0), (8, list(range(1, 12)), 9)]
    df = spark.createDataFrame(tasks, "task_id long, nums array<int>, target int")
    got = {r.task_id: r.n_solutions for r in CD.count_solutions(df).collect()}
    want = {t: _all_hits(n, g)[1] if n and g is not None and min(n) >= 0 and len(n) <= 10 else 0 for t, n, g in tasks[:7]}
    assert got == {**want, 8: None} and want[3] > 1000
    solved = {r.task_id: (r.solved, r.answer_raw) for r in CD.solve(df).collect()}
    assert solved[8] == (None, "") and solved[4] == (False, "") and solved[3][0]

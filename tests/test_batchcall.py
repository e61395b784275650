"""A user's function over bounded batches (H1, H2)."""

import os
import subprocess
import sys

import pytest

from postmill.operators import batchcall as BC
from postmill.operators.curate import split_kept
from tests.conftest import ROOT


def _lengths(frame):
    return {"n": [len(t) for t in frame["t"]], "rows": [len(frame)] * len(frame)}


def test_batches_are_bounded_in_rows_and_bytes(spark):
    rows = [(i, "x" * (10 if i != 7 else 5000)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    got = BC.call_in_batches(df, _lengths, "n int, rows int", ["t"], batch_rows=8, batch_bytes=100).collect()
    assert [(r.id, r.n) for r in got] == [(i, len(t)) for i, t in rows]
    assert max(r.rows for r in got) == 8 and {r.id for r in got if r.rows == 1} >= {7}  # a long row goes alone
    got = BC.call_in_batches(df, _lengths, "n int, rows int", ["t"], batch_rows=100, batch_bytes=35).collect()
    assert {r.rows for r in got if r.id < 6} == {3}


def test_a_raised_batch_becomes_rejects(spark):
    def fn(frame):
        if (frame["id"] == 13).any():
            raise RuntimeError("no answer")
        return {"out": frame["id"] * 2}

    df = spark.createDataFrame([(i,) for i in range(32)], "id long").coalesce(1)
    kept, rejects = split_kept(BC.call_in_batches(df, fn, "out long", batch_rows=16))
    assert sorted((r.id, r.out) for r in kept.collect()) == [(i, 2 * i) for i in range(32) if i != 13]
    assert [tuple(r) for r in rejects.collect()] == [(13, None, "RuntimeError: no answer")]
    whole = BC.call_in_batches(df, fn, "out long", batch_rows=16, isolate=False)
    assert sorted(r.id for r in split_kept(whole)[1].collect()) == list(range(16))


def test_retries_and_setup_once_a_task(spark):
    def setup():
        calls = {"n": 0}

        def fn(frame):
            calls["n"] += 1
            if calls["n"] % 2:
                raise ValueError("first try")
            return {"calls": [calls["n"]] * len(frame)}
        return fn

    df = spark.createDataFrame([(i,) for i in range(10)], "id long").coalesce(1)
    got = BC.call_in_batches(df, None, "calls int", setup=setup, batch_rows=5, retries=1).collect()
    assert {r.reject_reason for r in got} == {None} and {r.calls for r in got} == {2, 4}


@pytest.mark.parametrize("fn,word", [(lambda f: {"other": [1] * len(f)}, "no column out"), (lambda f: {"out": [1] * (len(f) + 1)}, "rows for"),
                                     (lambda f: {"out": ["a"] * len(f)}, "another type")])
def test_a_broken_schema_fails_the_job(spark, fn, word):
    df = spark.createDataFrame([(1,), (2,)], "id long").coalesce(1)
    with pytest.raises(Exception, match=word):
        BC.call_in_batches(df, fn, "out long").collect()


def test_names_arguments_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "é")], "id long, t string").coalesce(1)
    for bad in ("id long", "reject_reason string", "a int, a int"):
        with pytest.raises(ValueError, match="exist already"):
            BC.call_in_batches(df, _lengths, bad)
    with pytest.raises(ValueError):
        BC.call_in_batches(df, None, "n int")
    with pytest.raises(ValueError):
        BC.call_in_batches(df, _lengths, "n int", batch_rows=0)
    got = BC.call_in_batches(df, lambda f: {"none": f["t"].isna().tolist(), "back": f["t"]}, "none boolean, back string").collect()
    assert [(r.id, r.none, r.back) for r in got] == [(1, True, None), (2, False, "é")]

    def never(_):
        raise AssertionError("called")
    assert BC.call_in_batches(df.where("id > 9"), never, "n int", tasks=3).collect() == []


def test_rewards_that_do_not_parse_are_rejects(spark):
    df = spark.createDataFrame([(1, "reward: 2.5"), (2, "reward: ???"), (3, None)], "id long, request string")
    got = BC.reward(df, lambda f: {"reply": f["request"]}, ["request"]).collect()
    assert sorted((r.id, r.score, r.reject_reason) for r in got) == [(1, 2.5, None), (2, None, "unparsable"), (3, None, "unparsable")]


PLAIN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as E
from postmill.operators import countdown as CD
for name in ("countdown_solve", "batch_responses"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
tasks = spark.createDataFrame([(1, [15, 5, 75, 90], 21)], "task_id long, nums array<int>, target int")
print(CD.solve(tasks).first().answer_raw)
"""


def test_workers_import_the_package_in_a_plain_session_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PLAIN.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "(15 + (5 / (75 / 90)))" in out.stdout, out.stderr[-2000:]


def test_entry_without_the_optional_packages(tmp_path):
    """A package that only the training-data operators need may be missing; the rest is offered."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["public_tokenizers"] = None
import __spark_entry__ as E
names = E.queries()
assert "sft_pairs" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
print("ok")
"""
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("ok"), out.stderr[-2000:]

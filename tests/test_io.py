import json
import os

from pyspark.sql import functions as F

from postmill.sources import io as IO


def test_json_array_multi_path_keeps_duplicates(spark, tmpdir_path):
    rows = [{"input": "a", "chosen": "b", "rejected": "c"}]
    p1, p2 = os.path.join(tmpdir_path, "a.json"), os.path.join(tmpdir_path, "b.json")
    for p in (p1, p2):
        with open(p, "w") as f:
            json.dump(rows, f, indent=4)
    df = IO.read_json_array(spark, [p1, p2], IO.SCHEMAS["preference"])
    assert df.count() == 2


def test_json_lines_skips_blank_lines_and_renames(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cd.jsonl")
    with open(p, "w") as f:
        f.write('{"num": [15, 5, 75, 90], "expression": "", "target": 21}\n\n{"num": [1, 1], "expression": "", "target": 50}')
    df = IO.read_countdown(spark, p)
    assert sorted(r.target for r in df.collect()) == [21, 50]
    assert "nums" in df.columns


def test_prompt_list(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "prompts.json")
    with open(p, "w") as f:
        json.dump({"prompts": ["x", "y", "z"]}, f)
    rows = IO.read_prompt_list(spark, p).orderBy("prompt_idx").collect()
    assert [(r.prompt_idx, r.prompt) for r in rows] == [(0, "x"), (1, "y"), (2, "z")]


def test_split_pruning_and_param_naming(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "q string, split string")
    root = os.path.join(tmpdir_path, "corpus")
    df.write.partitionBy("split").parquet(root)
    assert [r.q for r in IO.read_split(spark, root, "test").collect()] == ["b"]
    out = os.path.join(tmpdir_path, "named")
    IO.write_with_params(df.drop("split"), out, max_in=128, max_out=512, split="train")
    assert os.path.isdir(os.path.join(out, "max_in=128", "max_out=512", "split=train"))


def test_guard_append_and_empty_output(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "sub")
    one = spark.createDataFrame([([1, 2], "Assistant: x", 3)], "nums array<int>, expression string, target int")
    IO.write_json_lines(IO.to_leaderboard(one), out, mode="append")
    IO.write_json_lines(IO.to_leaderboard(one), out, mode="append")
    assert spark.read.json(out).count() == 2
    IO.write_guarded(one.limit(0), out, overwrite=False)      # existing output kept
    assert spark.read.json(out).count() == 2
    empty = os.path.join(tmpdir_path, "empty")
    IO.write_json_lines(one.where(F.lit(False)), empty)        # no surviving rows: still valid
    assert spark.read.schema("target int").json(empty).count() == 0


def test_reward_vector(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "rewards")
    IO.write_reward_vector(spark.createDataFrame([(0, -1.5), (1, 2.0)], "item_idx int, reward double"), out)
    assert [r.reward for r in spark.read.parquet(out).orderBy("item_idx").collect()] == [-1.5, 2.0]


def test_corrupt_json_lines_are_kept_not_fatal(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bad.jsonl")
    with open(p, "w") as f:
        f.write('{"prompt": "ok"}\n{"prompt": \n{"prompt": "fine"}\n')
    df = IO.read_json_lines(spark, p, IO.SCHEMAS["instruction_leaderboard"], corrupt_col="_corrupt").cache()
    rows = df.collect()
    assert len(rows) == 3
    assert sum(r._corrupt is not None for r in rows) == 1
    assert sorted(r.prompt for r in rows if r.prompt) == ["fine", "ok"]


def test_array_lines_split_and_keep_rejects(spark, tmpdir_path):
    path = f"{tmpdir_path}/a.json"
    with open(path, "w") as f:
        f.write('[\n  {"nums": [1, 2], "target": 3},\n\n{"nums": [4], "target": 4} ,\n{"nums": [9],\n{"nums": [5], "target": 5}]\n')
    got = IO.read_json_array_lines(spark, path, IO.SCHEMAS["countdown_task"]).collect()
    assert [(r.nums, r.target) for r in got if not r.rejected] == [([1, 2], 3), ([4], 4), ([5], 5)]
    assert sum(r.rejected for r in got) == 1


def test_every_file_of_an_array_sink_is_valid_json(spark, tmpdir_path):
    rows = [(i, f'quote " back \\\\ line\n é日 {i}' if i % 5 else None, [i, i + 1]) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, t string, ids array<int>").repartition(4)
    IO.write_json_array(df, tmpdir_path + "/a")
    files = [f for f in os.listdir(tmpdir_path + "/a") if f.startswith("part-")]
    parts = [json.load(open(f"{tmpdir_path}/a/{f}", encoding="utf-8")) for f in files]
    assert sorted(len(p) == 0 for p in parts)[-1] and sum(map(len, parts)) == 57 and all("t" in x for p in parts for x in p)
    back = IO.read_json_array(spark, tmpdir_path + "/a", "id long, t string, ids array<int>")
    assert sorted(map(tuple, back.collect())) == rows
    IO.write_json_array(df.where("id < 0"), tmpdir_path + "/none")
    files = [f for f in os.listdir(tmpdir_path + "/none") if f.startswith("part-")]
    assert files and all(json.load(open(f"{tmpdir_path}/none/{f}")) == [] for f in files)
    assert IO.read_json_array(spark, tmpdir_path + "/none", "id long").count() == 0

"""Readers and writers for the corpora the pipeline exchanges.

Always with an explicit schema (never inferred). JSON *lines* are the default
interchange format because multi-line JSON files cannot be split across tasks;
JSON arrays are read for compatibility. Outputs are sharded by Spark's
writers; nothing is funnelled through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import let_workers_import

MESSAGE = "array<struct<role:string,content:string>>"
SCHEMAS = {
    "chat": f"messages {MESSAGE}",
    "warm_start": "query string, completion string",
    "raw_preference": (f"prompt string, chosen {MESSAGE}, rejected {MESSAGE}, "
                       "score_chosen double, score_rejected double"),
    "preference": "input string, chosen string, rejected string",
    "labelled_preference": "input string, chosen string, rejected string, chosen_reward double, rejected_reward double",
    "ai_feedback": "prompt string, good_response string, bad_response string, good_score double, bad_score double",
    "countdown_task": "nums array<int>, target int",
    "countdown_leaderboard": "num array<int>, expression string, target int",
    "solved_task": "nums array<int>, target int, answer string",
    "rl_prompt": "input string, ground_truth struct<target:int,numbers:array<int>>",
    "teacher_response": "numbers array<int>, target int, response string, score double",
    "instruction_leaderboard": "prompt string",
}


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """One or more JSON-array files of any layout, concatenated with duplicates kept (A1).
    A file is one task; ``read_json_array_lines`` splits files with one element a line."""
    ps = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("multiLine", True).json(ps)


def parse_array_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Rows of a JSON array written one element a line: brackets, commas and blank lines
    go, the rest is parsed into ``row``; what does not parse has ``rejected`` set (A1)."""
    text = F.regexp_replace(F.btrim(F.col(line)), r"^\[\s*|\s*\]$", "")
    d = lines.withColumn("_text", F.btrim(F.regexp_replace(text, r"\s*,$", ""))).where(F.length("_text") > 0)
    fields = d.withColumn("row", F.from_json("_text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return fields.withColumn("rejected", F.col("row").isNull() | F.col("row._bad").isNotNull()).drop("_text")


def read_json_array_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON-array files with one element a line, split across tasks like any text (A1).
    Bad elements are kept as rows with ``rejected`` set."""
    ps = [paths] if isinstance(paths, str) else list(paths)
    names = spark.createDataFrame([], schema).columns
    out = parse_array_lines(spark.read.text(ps), "value", schema)
    return out.select(*[F.col("row")[n].alias(n) for n in names], "rejected")


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, mode: str = "PERMISSIVE",
                    corrupt_col: str | None = None) -> DataFrame:
    """JSON lines, one object per non-blank line (A2). With ``corrupt_col`` bad
    lines are kept in that column instead of failing the job."""
    r = spark.read.schema(schema if corrupt_col is None else f"{schema}, {corrupt_col} string").option("mode", mode)
    if corrupt_col:
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    return r.json(path)


def read_prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """``{"prompts": [...]}`` -> (prompt_idx, prompt) rows (A3)."""
    d = spark.read.schema("prompts array<string>").option("multiLine", True).json(path)
    return d.select(F.posexplode("prompts").alias("prompt_idx", "prompt"))


def read_prompt_lists(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Prompt lists as JSON lines, an object with ``prompts`` a line: (key, prompt_idx, prompt)
    rows (A3). Unlike a list in one file, lists split across tasks. ``key`` declares a
    column that names the list."""
    d = spark.read.schema(", ".join(filter(None, [key, "prompts array<string>"]))).json(path)
    return d.select(*d.columns[:-1], F.posexplode("prompts").alias("prompt_idx", "prompt"))


def read_split(spark: SparkSession, root: str, split: str, fmt: str = "parquet") -> DataFrame:
    """Split-addressed corpus stored partitioned by ``split`` (A4); the
    predicate prunes partitions at planning time."""
    return spark.read.format(fmt).load(root).where(F.col("split") == split)


def read_countdown(spark: SparkSession, path: str, form: str = "leaderboard") -> DataFrame:
    """Countdown tasks in either key spelling, normalised to ``nums`` (A2)."""
    if form == "leaderboard":
        d = read_json_lines(spark, path, SCHEMAS["countdown_leaderboard"])
        return d.withColumnRenamed("num", "nums")
    return read_json_lines(spark, path, SCHEMAS["countdown_task"])


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-array sink (A5): every part file is a valid array, one element a line, so files
    are written and read side by side; concatenated paths are the union. A task holds one
    element back to end its array without a comma. One more file holds an empty array, so
    the output is valid JSON even if no row survives."""
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                ready, last = ([] if last is None else [last]) + lines[:-1], lines[-1]
                yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in ready], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(([] if last is None else [last]) + ["]"], pa.string())], names=["value"])

    def nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["value"])

    let_workers_import(df.sparkSession)
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    empty = df.sparkSession.range(1).select(F.col("id").cast("string").alias("value")).mapInArrow(nothing, "value string")
    rows.union(empty).mapInArrow(arrays, "value string").write.mode(mode).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Sharded JSON-lines sink (A6 with mode='append'), the default for exchange as lines split
    across tasks."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_guarded(df: DataFrame, path: str, overwrite: bool, fmt: str = "json") -> None:
    """Overwrite guard (A7): keep an existing output unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").format(fmt).save(path)


def write_reward_vector(df: DataFrame, path: str, idx: str = "item_idx", reward: str = "reward") -> None:
    """Reward-per-item sink (A8); evaluation order is a column, not file order."""
    df.select(F.col(idx).cast("bigint").alias("item_idx"), F.col(reward).cast("double").alias("reward")) \
        .write.mode("overwrite").parquet(path)


def write_with_params(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", **params) -> None:
    """Output addressed by run parameters (A9): each parameter becomes a
    partition column (``max_in=128/max_out=512/split=train``), so several runs
    coexist and readers prune by parameter."""
    d = df
    for k, v in params.items():
        d = d.withColumn(k, F.lit(v))
    d.write.mode(mode).partitionBy(*params.keys()).format(fmt).save(path)


def to_leaderboard(df: DataFrame) -> DataFrame:
    """Submission rows in the leaderboard spelling ``{num, expression, target}``."""
    return df.select(F.col("nums").alias("num"), F.col("expression"), F.col("target"))

"""Round trips through files and streams (A2-A9, C9, G8, K1, K2): what is written to the
shared folder is read back, so a query's rows depend on the sink and on the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import curate as C
from postmill.plans import inputs as I
from postmill.plans import sqlbits as S
from postmill.plans.registry import query
from postmill.sources import io as IO
from postmill.sources.outcomes import read_outcomes, write_outcomes
from postmill.sources.scratch import RunFolder
from postmill.sources.tables import table
from postmill.streaming import jobs as J
from postmill.streaming.accounted import AccountedWindows

NL = "chr(10)"
REASONS = ("missing_role", "bad_shape", "over_budget")
OUTCOME_SQL = f"""SELECT conv_id, CASE WHEN user_text IS NULL OR assistant_text IS NULL THEN 'missing_role'
       WHEN {S.words('user_text')} > 30 OR {S.words('assistant_text')} > 150 THEN 'over_budget' ELSE 'kept' END AS outcome
FROM ({S.first_turns()})"""


def _curated(spark, sf_dir):
    return C.curate_chat(C.first_turns(table(spark, sf_dir, "conversations")), max_in=30, max_out=150)


@query("filter_written", f"""
WITH o AS ({OUTCOME_SQL}), n AS (SELECT outcome, count(*) AS n FROM o GROUP BY outcome)
SELECT r.outcome, coalesce(n.n, 0) AS n_observed, coalesce(n.n, 0) AS n_written
FROM (SELECT unnest(['kept', 'missing_role', 'bad_shape', 'over_budget']) AS outcome) r LEFT JOIN n ON n.outcome = r.outcome""")
def filter_written(spark, sf_dir):
    """Filter accounting taken while kept and rejected rows are written, beside the rows
    that the folders hold (G8, C9)."""
    path = RunFolder(spark, "filter").at("rows")
    seen = write_outcomes(_curated(spark, sf_dir), path, REASONS)
    written = read_outcomes(spark, path, "conv_id bigint").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_written"))
    observed = spark.createDataFrame(list(seen.items()), "outcome string, n_observed bigint")
    return observed.join(written, "outcome", "left").select("outcome", "n_observed", F.coalesce("n_written", F.lit(0).cast("bigint")).alias("n_written"))


@query("outcome_rows", f"""
WITH o AS ({OUTCOME_SQL})
SELECT conv_id, user_text, outcome FROM o JOIN ({S.first_turns()}) USING (conv_id) WHERE outcome = 'kept'
UNION ALL SELECT conv_id, user_text, outcome FROM o JOIN ({S.first_turns()}) USING (conv_id) WHERE outcome <> 'kept'""")
def outcome_rows(spark, sf_dir):
    """Both sides of a filter from one write, each read from its own folders."""
    path = RunFolder(spark, "outcomes").at("rows")
    write_outcomes(_curated(spark, sf_dir), path, REASONS)
    schema = "conv_id bigint, user_text string"
    return read_outcomes(spark, path, schema, ["kept"]).unionByName(read_outcomes(spark, path, schema, REASONS))


@query("split_round_trip", """
SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents""")
def split_round_trip(spark, sf_dir):
    """A corpus written by split and read split by split, each scan pruned to its folder (A4)."""
    root = RunFolder(spark, "splits").at("corpus")
    d = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    d.write.partitionBy("split").parquet(root)
    both = IO.read_split(spark, root, "train").unionByName(IO.read_split(spark, root, "test"))
    return both.select("doc_id", "lang", F.length("text").alias("n_chars"), "split")


@query("json_lines_round_trip", """
SELECT CASE WHEN event_id % 13 <> 5 THEN event_id END AS event_id, CASE WHEN event_id % 13 <> 5 THEN event_type END AS event_type,
       CASE WHEN event_id % 13 = 5 THEN '{"event_id": ' || event_id || ', "event_' END AS bad FROM events""")
def json_lines_round_trip(spark, sf_dir):
    """JSON lines with blank and broken lines among them, read with an explicit schema: blank
    lines are skipped, broken ones kept in a column of their own (A2)."""
    path = RunFolder(spark, "lines").at("events")
    ev = table(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", "event_type"))
    broken = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_'))
    blank = F.when(F.col("event_id") % 17 == 0, F.lit("\n")).otherwise(F.lit(""))
    ev.select(F.concat(F.when(F.col("event_id") % 13 == 5, broken).otherwise(whole), blank).alias("value")).write.text(path)
    return IO.read_json_lines(spark, path, "event_id bigint, event_type string", corrupt_col="bad")


@query("json_array_round_trip", f"""
SELECT conv_id, user_text AS input, assistant_text AS chosen, CAST(NULL AS VARCHAR) AS rejected FROM ({S.first_turns()})""")
def json_array_round_trip(spark, sf_dir):
    """Rows written as JSON arrays, a valid one in every file, and read back (A5, A1)."""
    path = RunFolder(spark, "arrays").at("rows")
    rows = C.first_turns(table(spark, sf_dir, "conversations"))
    IO.write_json_array(rows.select("conv_id", F.col("user_text").alias("input"), F.col("assistant_text").alias("chosen"), F.lit(None).cast("string").alias("rejected")), path)
    return IO.read_json_array(spark, path, "conv_id bigint, " + IO.SCHEMAS["preference"])


@query("prompt_lists_round_trip", """
SELECT CAST(item_id // 8 AS BIGINT) AS list_id, CAST(row_number() OVER (PARTITION BY item_id // 8 ORDER BY item_id) - 1 AS INTEGER) AS prompt_idx,
       text AS prompt FROM benchmark""")
def prompt_lists_round_trip(spark, sf_dir):
    """Prompts written as lists of eight, an object a line, and read back prompt by prompt (A3)."""
    path = RunFolder(spark, "prompts").at("lists")
    b = table(spark, sf_dir, "benchmark").withColumn("list_id", F.floor(F.col("item_id") / 8).cast("bigint"))
    lists = b.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("items"))  # eight at most
    IO.write_json_lines(lists.select("list_id", F.transform("items", lambda x: x["text"]).alias("prompts")), path)
    return IO.read_prompt_lists(spark, path, key="list_id bigint")


@query("guarded_write", """
SELECT 'kept' AS step, item_id, CAST(1 AS INTEGER) AS version FROM benchmark
UNION ALL SELECT 'overwritten', item_id, CAST(2 AS INTEGER) FROM benchmark""")
def guarded_write(spark, sf_dir):
    """An existing output stays unless overwriting is asked for."""
    folder = RunFolder(spark, "guarded")
    b = table(spark, sf_dir, "benchmark").select("item_id")
    for name, overwrite in (("kept", False), ("overwritten", True)):
        IO.write_guarded(b.withColumn("version", F.lit(1)), folder.at(name), overwrite=False, fmt="parquet")
        IO.write_guarded(b.withColumn("version", F.lit(2)), folder.at(name), overwrite=overwrite, fmt="parquet")
    read = lambda name: spark.read.schema("item_id bigint, version int").parquet(folder.at(name))
    return read("kept").select(F.lit("kept").alias("step"), "*").unionByName(read("overwritten").select(F.lit("overwritten").alias("step"), "*"))


@query("reward_vector_round_trip", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'reward: n/a'
                    WHEN event_id % 5 = 0 THEN 'score:reward:' || CAST(round(value * 100) AS BIGINT)
                    ELSE 'reward:' || CAST(round(value * 100) AS BIGINT) END AS reply FROM events)
SELECT event_id AS item_idx, TRY_CAST({S.strip("string_split(reply, ':')[-1]")} AS DOUBLE) AS reward FROM e""")
def reward_vector_round_trip(spark, sf_dir):
    """Parsed rewards written with their place as a column, and read back."""
    from postmill.functions.answer import parse_reward
    path = RunFolder(spark, "rewards").at("vector")
    r = I.event_replies(spark, sf_dir)
    IO.write_reward_vector(r.select("event_id", parse_reward(F.col("reply"), "last").alias("reward")), path, idx="event_id")
    return spark.read.schema("item_idx bigint, reward double").parquet(path)


@query("named_outputs", f"""
WITH ft AS ({S.first_turns()}), w AS (SELECT conv_id, {S.words('user_text')} AS i, {S.words('assistant_text')} AS o FROM ft
  WHERE user_text IS NOT NULL AND assistant_text IS NOT NULL)
SELECT conv_id, p.max_in, p.max_out FROM w, (SELECT CAST(unnest([30, 128]) AS INTEGER) AS max_in, CAST(unnest([150, 512]) AS INTEGER) AS max_out) p
WHERE i <= max_in AND o <= max_out""")
def named_outputs(spark, sf_dir):
    """The same curation under two budgets, both written under one root by their parameters
    and read back by them (A9, A6)."""
    root = RunFolder(spark, "named").at("sft")
    pairs = C.first_turns(table(spark, sf_dir, "conversations"))
    for max_in, max_out in ((30, 150), (128, 512)):
        kept, _ = C.split_kept(C.curate_chat(pairs, max_in=max_in, max_out=max_out))
        IO.write_with_params(kept.select("conv_id"), root, fmt="parquet", mode="append", max_in=max_in, max_out=max_out)
    return spark.read.schema("conv_id bigint, max_in int, max_out int").parquet(root).where("max_in IN (30, 128)")


@query("stream_score_run", f"""
WITH a AS ({S.ANSWERS}) SELECT task_id, response, {S.ANSWER_SCORE} AS score FROM a""")
def stream_score_run(spark, sf_dir):
    """Responses arrive as files in two parts; a stream scores and appends them, is started
    again from its checkpoint for the second part and once more for nothing, and the sink
    is read back: every response once (K1, A6)."""
    folder = RunFolder(spark, "scores")
    answers, tasks = I.answers(spark, sf_dir).select("task_id", "response"), I.tasks(spark, sf_dir)
    for part in (0, 1, None):
        if part is not None:
            IO.write_json_lines(answers.where(F.col("task_id") % 2 == part), folder.at("in"), mode="append")
        J.start_scoring(spark, folder.at("in"), tasks, folder.at("out"), folder.at("checkpoint")).awaitTermination()
    return spark.read.schema("task_id bigint, response string, score double").json(folder.at("out"))


ARRIVALS = 4  # parts in which the events arrive; some come one or two parts late


@query("stream_windows_accounted", f"""
WITH c AS (SELECT max(event_id) + 1 AS c FROM events),
e AS (SELECT ts, event_type, value, date_trunc('hour', ts) AS w, least({ARRIVALS - 1}, event_id * {ARRIVALS} // c
        + CASE WHEN event_id % 37 = 5 THEN 1 WHEN event_id % 101 = 7 THEN 2 ELSE 0 END) AS b FROM events, c),
m AS (SELECT b, max(ts) AS seen FROM e GROUP BY b),
k AS (SELECT e.*, coalesce(w + INTERVAL 1 HOUR <= (SELECT max(seen) FROM m WHERE m.b < e.b) - INTERVAL 10 MINUTE, false) AS late FROM e),
f AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT CASE WHEN late THEN 'late' WHEN w + INTERVAL 1 HOUR <= mark THEN 'closed' ELSE 'open' END AS kind,
       strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS run, count(*) AS n, round(avg(value), 6) AS mean_reward
FROM k, f GROUP BY 1, 2, 3""")
def stream_windows_accounted(spark, sf_dir):
    """Events arrive in four parts, some rows late: a stream, started anew for each part,
    sums up windows; late rows are kept aside, so closed, open and late rows make up all
    that came in (K2)."""
    folder = RunFolder(spark, "windows")
    ev = table(spark, sf_dir, "events")
    last = ev.agg(F.max("event_id")).first()[0]
    late = F.when(F.col("event_id") % 37 == 5, 1).when(F.col("event_id") % 101 == 7, 2).otherwise(0)
    part = F.least(F.lit(ARRIVALS - 1), F.expr(f"event_id * {ARRIVALS} div {(last or 0) + 1}") + late)
    job = AccountedWindows(spark, folder.at("job"))
    for k in range(ARRIVALS):
        ev.where(part == k).write.mode("append").parquet(folder.at("in"))
        job.feed(spark.readStream.schema(J.EVENT_SCHEMA).parquet(folder.at("in"))).awaitTermination()
    shown = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    kept = job.windows().select(F.when(F.col("closed"), "closed").otherwise("open").alias("kind"), shown, "run", "n", F.round("mean_reward", 6).alias("mean_reward"))
    lost = job.rejected().groupBy(shown, F.col("event_type").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_reward"))
    return kept.unionByName(lost.select(F.lit("late").alias("kind"), "*"))

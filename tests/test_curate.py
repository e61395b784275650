"""Curation operators."""

from pyspark.sql import functions as F

from postmill.operators import curate as C
from tests.conftest import SF_SMALL
from postmill.sources.tables import table

CONV = [(1, 0, "user", "hi there"), (1, 1, "assistant", "hello  you"), (1, 2, "user", "more"),
        (2, 0, "assistant", "first"), (2, 1, "user", "q"),
        (3, 0, "user", "only user"),
        (4, 0, "system", "  "), (4, 1, "user", "u"), (4, 2, "assistant", "a")]


def conv(spark):
    return spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string")


def test_first_turns_and_budget(spark):
    out = C.curate_chat(C.first_turns(conv(spark)), max_in=2, max_out=3)
    got = {r.conv_id: (r.in_words, r.out_words, r.reject_reason) for r in out.collect()}
    assert got[1] == (2, 3, None)              # "hello  you" -> 3 words (double space)
    assert got[2] == (1, 1, None)              # role order does not matter
    assert got[3][2] == "missing_role"
    kept, rej = C.split_kept(out)
    assert kept.count() + rej.count() == out.count() == 4


def test_shape_check_both_modes(spark):
    pairs = C.first_turns(conv(spark))
    strict = C.curate_chat(pairs, use_system=True, system_text="")
    lenient = C.curate_chat(pairs, use_system=True, system_text="", allow_system=True)
    assert strict.where(F.col("reject_reason").isNull()).count() == 0       # reference quirk
    assert lenient.where(F.col("reject_reason").isNull()).count() == 3


def test_warm_start_parse(spark):
    df = spark.createDataFrame([("Sys. User: what is 2+2? \nAssistant: ok", "4"), ("no marker\nAssistant:", "x")],
                               "query string, completion string")
    out = C.curate_warm_start(df).collect()
    assert out[0].user_content == "what is 2+2?" and out[0].reject_reason is None
    assert out[1].user_content is None and out[1].reject_reason == "no_user_marker"


def test_render_and_spans_agree(spark):
    c = conv(spark)
    text = {r.conv_id: r.text for r in C.render_conversations(c).collect()}
    assert text[4].startswith("<|im_start|>system\nYou are a helpful assistant.")   # blank system skipped
    for r in C.assistant_spans(c, chunk=1).collect():
        t = text[r.conv_id]
        assert t[r.span_start:r.span_end].endswith("<|im_end|>\n")
        assert t[r.span_start - len("<|im_start|>assistant\n"):r.span_start] == "<|im_start|>assistant\n"


def test_filter_counts_cover_all_rows(spark):
    conv_t = table(spark, SF_SMALL, "conversations")
    out = C.curate_chat(C.first_turns(conv_t), max_in=30, max_out=150)
    total = sum(r.n for r in C.filter_counts(out).collect())
    assert total == conv_t.select("conv_id").distinct().count()


def test_nested_rendering_equals_the_flat_form(spark):
    import random
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        n = rng.choice([0, 1, 2, 5, 63, 64, 65, 200])
        rows.append((conv, [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", " ", "hi", "é日🙂\n", "x" * 50])) for _ in range(n)]))
    nested = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>")
    flat = spark.createDataFrame([(c, t, r, x) for c, ms in rows for t, (r, x) in enumerate(ms)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.r for r in nested.select("conv_id", C.render_messages("messages").alias("r")).collect()}
    texts = {r.conv_id: r.text for r in C.render_conversations(flat).collect()}
    spans = {}
    for r in C.assistant_spans(flat).collect():
        spans.setdefault(r.conv_id, []).append((r.turn, r.span_start, r.span_end))
    for conv, ms in rows:
        assert got[conv].text == texts.get(conv, "")
        assert [tuple(s) for s in got[conv].spans] == [(a, b) for _, a, b in sorted(spans.get(conv, []))]
        said = [x for r, x in ms if r == "assistant"]
        assert [got[conv].text[s.start:s.end] for s in got[conv].spans] == [f"{x}<|im_end|>\n" for x in said]


def test_nested_rendering_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [("user", None), (None, "x"), ("assistant", "y")]), (3, [("assistant", None)])],
                               "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: r.r for r in df.select("id", C.render_messages("messages").alias("r")).collect()}
    assert got[1] is None and got[3].text == "" and got[3].spans == []
    assert got[2].text == "<|im_start|>assistant\ny<|im_end|>\n" and [tuple(s) for s in got[2].spans] == [(22, 34)]

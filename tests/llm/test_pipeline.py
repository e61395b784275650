"""The pipeline's rows against each stage's own brute-force version, stage by stage."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from postmill.llm import pfair
from postmill.llm import quality as Q
from tests.conftest import SF_SMALL
from tests.llm.test_dartminhash import brute_classes
from tests.llm.test_linededup import brute as brute_lines


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS)
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    kept = {r.k_id for r in Q.classify(spark.createDataFrame(list(first.values())), spark.read.parquet(f"{SF_SMALL}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in seen["quality_classifier"]} == kept and 0 < len(kept) < len(first)
    lines = {i: t for i, _, _, t in brute_lines([(i, first[i].text) for i in kept])}
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == lines
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    classes = brute_classes(list(lines.items()))
    assert {r.doc_id for r in seen["minhash_near_dedup"]} == {i for i in lines if classes[i] == i}
    assert {r.doc_id for r in seen["source_mix"]} == {r.doc_id for r in seen["minhash_near_dedup"]}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in seen["bpe_encode_decode"]}
    assert last.keys() == {r.doc_id for r in seen["source_mix"]}
    for i, r in last.items():
        ids = lib.encode(lines[i], add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {tuple(map(str, r)) for r in P.run(spark, SF_SMALL).collect()} == {tuple(map(str, r)) for r in seen["bpe_encode_decode"]}


def test_near_duplicate_stage_on_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 7), (2, "a b c d e f g", "en", "s", 7), (3, None, None, None, None), (None, "q", "en", "s", 1),
            (4, "", "en", "s", 0), (5, "", "en", "s", 0), (1, "a b c d e f g", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "4", "None"]
    assert P.drop_near_duplicates(spark, docs.limit(0), SF_SMALL).count() == 0
    assert P.dedup_lines(spark, docs.limit(0), SF_SMALL).count() == 0
    assert P.mix_sources(spark, docs, SF_SMALL).count() == len(rows)


def test_copies_and_texts_of_shared_lines_keep_one_document(spark, tmp_path):
    copies, shared = "Alpha beta gamma.\n\nDelta epsilon zeta eta.", "only a shared line here"
    rows = [(i, copies) for i in range(12)] + [(20 + i, f"{shared}\nown words of number {i} {i * 7}") for i in range(11)]
    rows += [(40, f"{shared}\n"), (41, "a line that nobody has"), (42, ""), (43, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    P.dedup_lines(spark, docs, SF_SMALL).write.parquet(str(tmp_path / "lines"))
    out = spark.read.parquet(str(tmp_path / "lines"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(rows) and all(got[i] == copies for i in range(12)) and got[40] == f"{shared}\n"
    assert all(got[20 + i] == f"own words of number {i} {i * 7}" for i in range(11)) and got[41] == "a line that nobody has"
    assert all(r.n_chars == len(r.text) for r in out.collect())
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, out, SF_SMALL).collect()}
    assert kept & set(range(12)) == {0} and {40, 41} <= kept


def test_result_has_the_place_that_the_mix_gave(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i % 390, f"text {i % 390}", "en", f"s{i % 7 % 4}", 8) for i in range(400)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    mixed = pfair.mix(docs).collect()
    want = [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_slot, r.mix_offset))]
    P.mix_sources(spark, docs, SF_SMALL).write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "mix"))
    out = P.encode(spark, spark.read.parquet(str(tmp_path / "mix")), SF_SMALL).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.mix_position)] == want
    assert sorted(r.mix_position for r in out) == list(range(400))
    (tmp_path / "in").mkdir()
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(P, "STAGES", P.STAGES[3:])
    assert [r.doc_id for r in sorted(P.run(spark, str(tmp_path / "in")).collect(), key=lambda r: r.mix_position)] == want


def test_clean_text_stays_when_its_id_has_a_copy_too(spark):
    a, b = "one text of seven words or so", "quite another text that has no copy at all"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(0, a), (1, a), (1, b), (1, b)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF_SMALL).collect()) == [(0, a), (1, b)]


ODD = [(1, "some words here", "en", "a", 15), (2, None, None, None, None), (None, "", "en", "a", 0), (3, "<|endoftext|> é日🙂", "fr", "b", 1),
       (4, "long text " * 60_000, "en", "a", 600_000), (4, "long text " * 60_000, "en", "a", 600_000)]


def test_encode_of_rows_in_memory_with_clashing_names(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(*r, "f", 1, 2, 3) for r in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, file string, file_row long, file_before long, mix_position int")
    got = P.encode(spark, docs, SF_SMALL).collect()
    want = sorted((r[0] or 0, lib.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD)
    assert sorted((r.doc_id or 0, r.ids) for r in got) == want
    assert {r.mix_position for r in got} == {None} and all(r.n_tokens == len(r.ids) for r in got)
    assert P.encode(spark, docs.limit(0), SF_SMALL).count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES[:4])
def test_stages_take_odd_rows_extra_columns_and_empty_tables(spark, name, stage):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, kept string, mix_slot long")
    out = stage(spark, docs, SF_SMALL)
    assert out.columns == list(P.COLUMNS)
    rows = out.collect()
    assert any(r.doc_id == 1 and r.text == "some words here" for r in rows) or name == "quality_classifier"
    assert stage(spark, docs.limit(0), SF_SMALL).collect() == []

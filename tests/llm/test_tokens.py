"""Token counts and BPE round trips against the libraries that define them."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from postmill.llm import bpe, tokencount
from postmill.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "a\n\nb", "<s>x</s>", "▁a  ▁▁▁", "\xa0x\t y", "ﬁ Å", "<0x0A>", "ΑΣ ΟΔΥΣΣΕΥΣ", "x" * 3000, " " * 100,
       "<|startoftext|>Hello<|endoftext|> <|x|>", "日本語テキスト🙂🙂", "don't I'LL we've", "İstanbul é́", "a\x00b\x1cc\x85d e",
       "１２３ ½ ²", " \n \n  \t", "ab" * 500 + "zzz" * 300, "!!!???###" * 100, "\r\n x\r"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.piece_counter(PIECES)


@pytest.fixture(scope="module")
def word_model():
    return bpe.WordBPE(bpe.read_file(WORDS))


PIECE_LIB = sentencepiece.SentencePieceProcessor(model_file=PIECES)
WORD_LIB = Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(counter, word_model, text):
    assert counter.count(text) == len(PIECE_LIB.encode(text))
    ids = WORD_LIB.encode(text, add_special_tokens=False).ids
    assert word_model.encode(text) == ids
    assert word_model.decode(ids) == WORD_LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the▁ \n\té日🙂.'s1!<|> Σ"), max_size=120))
def test_any_text(text):
    counter, words = _models()
    assert counter.count(text) == len(PIECE_LIB.encode(text))
    assert words.encode(text) == WORD_LIB.encode(text, add_special_tokens=False).ids


def _models(cache=[]):
    if not cache:
        cache.extend([tokencount.piece_counter(PIECES), bpe.WordBPE(bpe.read_file(WORDS))])
    return cache


def test_whole_tokens_are_proven(counter):
    assert len(counter.whole) > 30_000
    for p in random.Random(1).sample(sorted(counter.whole), 200):
        assert len(counter.pieces) and counter.tokens_of(p) == 1


def test_forced_cuts_lie_in_no_token(word_model):
    parts = list(word_model.fragments_of(word_model.symbols("thxqzkwjtion")))
    assert len(parts) > 1 and "".join(map("".join, parts)) == "thxqzkwjtion</w>"
    for a, b in zip(parts, parts[1:]):
        assert (a[-1], b[0]) not in word_model.inside


def test_queries_match_the_libraries(spark):
    import hashlib
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    five = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SF_SMALL).collect()}
    seven = {r.doc_id: r for r in QUERIES["op7_bpe_round_trip"](spark, SF_SMALL).collect()}
    assert five.keys() == seven.keys() == rows.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, text in rows.items():
        n = len(PIECE_LIB.encode(text or ""))
        assert (five[k].n_bytes, five[k].n_tokens, five[k].over_limit) == (len((text or "").encode()), n, n > 4096)
        ids = WORD_LIB.encode(text or "", add_special_tokens=False).ids
        assert (seven[k].n_tokens, seven[k].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert seven[k].decoded_sha256 == sha(WORD_LIB.decode(ids, skip_special_tokens=False))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (None, "a b", 6, "y"), (2, "", 7, "z"), (2, "", 7, "z")],
                                 "doc_id long, text string, n_tokens long, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.token_counts(docs, PIECES).collect())
    assert got == [(0, 2), (1, 0), (2, 0), (2, 0)]
    got = sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in bpe.encode_decode(docs, WORDS).collect())
    assert got == [(0, 2, "a</w> b</w>"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert tokencount.token_counts(docs.limit(0), PIECES).count() == 0
    assert bpe.encode_decode(docs.limit(0), WORDS).count() == 0

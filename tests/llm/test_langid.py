import re
from collections import Counter

import pytest

from postmill.llm import langid as G
from postmill.llm.queries import QUERIES
from tests.conftest import SF_CHECK


def test_query_predicts_held_out_documents(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op1_language_id"](spark, SF_CHECK).collect()
    assert len(got) == len(want)
    held = [r for r in got if r.held_out]
    assert 0.25 < len(held) / len(got) < 0.42
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def unpack(key):
    out = ""
    while key:
        key, c = divmod(key, 1 << G.BITS)
        out = chr(c) + out
    return out


def brute_counts(text):
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        counts.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i:i + n]) != " ")
    return counts


def brute_distance(text, profile, k):
    counts = brute_counts(text)
    own = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:k]
    return sum(abs(i - profile.index(g)) if g in profile else k for i, g in enumerate(own)) / (k * len(own))


@pytest.mark.parametrize("text", ["", " ", "a", "The cat's 2 hats_and ÉTÉ!\nx", "日本 語", "aa aa  b\tc", "ﬁ İ ΑΣ 🙂 z"])
def test_grams_match_brute_force(text):
    keys, counts = G.grams(text)
    assert {unpack(k): c for k, c in zip(keys.tolist(), counts.tolist())} == brute_counts(text)
    assert list(keys) == sorted(keys)


def test_profiles_and_distances_match_brute_force(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "the dog", "en"), (4, "x", None), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = G.learn_profiles(docs, k=30)
    assert p.langs == ["en", "fr"]
    prof = {}
    for c, lang in enumerate(p.langs):
        places = sorted((int(p.rank[r, c]), unpack(int(k))) for r, k in enumerate(p.keys) if p.rank[r, c] >= 0)
        prof[lang] = [g for _, g in places]
        counts = brute_counts(" ".join(t for _, t, x in rows if x == lang and t))
        assert prof[lang] == sorted(counts, key=lambda g: (-counts[g], len(g), g))[:30]
    for text in ("the cat", "la table", "zzz"):
        want = min((brute_distance(text, prof[x], 30), x) for x in p.langs)
        lang, score = p.predict(text)
        assert lang == want[1] and abs(score - (1 - want[0])) < 1e-12


def test_nulls_letters_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 !? \n", "en", 1), (None, "the the", "en", 1), (4, "the", "en", 1), (4, "the", "en", 1)],
                                 "doc_id long, text string, lang string, score int")
    p = G.learn_profiles(docs)
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in G.predict_langs(docs, p).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    none = G.learn_profiles(docs.limit(0))
    assert {r.lang_pred for r in G.predict_langs(docs, none).collect()} == {"und"}
    assert G.predict_langs(docs.limit(0), p).count() == 0

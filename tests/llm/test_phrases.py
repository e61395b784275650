import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import phrases as P
from postmill.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, top, least):
    """By the definition, every phrase counted: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longest = defaultdict(int)
    for (lang, p), a in found.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longest[lang, q] = max(longest[lang, q], a)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * longest[lang, p] >= 50 * a and longest[lang, p]:
            continue
        s, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top]))


def corpus():
    """A hot language with copies (ties at the top), rare languages, odd texts."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)] + ["École", "straße", "日本", "Of", "the"]
    rows = [("en", " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "Alpha beta GAMMA delta. epsilon zeta\teta")] * 30 + [("fr", "un deux trois, quatre cinq")] * 12
    rows += [("de", "eins zwei")] * 9 + [("de", "eins zwei drei")] * 11 + [("de", "eins zwei vier! zwei eins zwei")] * 13
    rows += [(None, "no lang here ever")] * 10 + [("und", "no lang here at all")] * 5 + [("xx", None), ("xx", ""), (None, None), ("yy", " .,;\n\t")]
    rows += [("en", "of the " * 4000), ("en", ":".join(rng.choice(pool) for _ in range(3000)))]
    return rows


@pytest.mark.parametrize("top,least", [(5, 10), (40, 3), (2000, 10), (1, 2), (300, 2)])
def test_brute_force(spark, top, least):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, score int, rank string").repartition(5)
    got = sorted(map(tuple, P.mine(docs, top=top, least=least).collect()))
    assert got == brute(rows, top, least)


def test_threshold_falls_until_settled(spark):
    """Most top pairs are replaced by triples, so the first thresholds settle nothing."""
    rows = [("en", f"a{i} b{i} c{i}") for i in range(60) for _ in range(10)] + [("en", f"p{i} q{i % 20}") for i in range(60) for _ in range(10)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (30, 61, 90, 119, 200):
        assert sorted(map(tuple, P.mine(docs, top=top).collect())) == brute(rows, top, 10)


def test_crowded_buckets_only_admit_more(spark, monkeypatch):
    """With far fewer buckets than keys the flags run together and the result stays."""
    rows = corpus()
    monkeypatch.setattr(P, "buckets", lambda h: (h & np.uint64(7)).astype(np.int64))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, P.mine(docs, top=25).collect())) == brute(rows, 25, 10)


def test_scores_are_exact_past_64_bits(spark):
    rng = random.Random(1)
    rows = [(a, rng.randint(a, 4 * a), rng.randint(a, 4 * a)) for a in (rng.randint(10, 4 * 10**12) for _ in range(300))]
    rows += [(3 * 10**12, 3 * 10**12, 3 * 10**12), (10**12, 10**12 + 1, 10**12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", P.score("a", "l", "r").alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


def test_parsed_slice():
    p = P.Parsed(pa.array(["a", None, "a", "b"]), pa.array(["X y.z", None, "y\tZ", "é"]))
    assert p.words.take(pa.array(p.word)).to_pylist() == ["x", "y", "z", "y", "z", "é"]
    assert p.follows.tolist() == [True, False, False, True, False]
    assert p.langs.take(pa.array(p.lang)).to_pylist() == ["a", "a", "a", "a", "a", "b"]
    assert len(P.Parsed(pa.array([], pa.string()), pa.array([], pa.string())).word) == 0
    sliced = P.Parsed(pa.array(["a", "b", "c"]).slice(1), pa.array(["q", "r s", "t"]).slice(1))
    assert sliced.words.take(pa.array(sliced.word)).to_pylist() == ["r", "s", "t"] and sliced.follows.tolist() == [True, False]


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "one two")]])
def test_nothing_to_find(spark, rows):
    out = P.mine(spark.createDataFrame(rows, "lang string, text string"))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = QUERIES["op12_phrases"](spark, SF_SMALL)
    res = con.execute(ORACLE["op12_phrases"])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())

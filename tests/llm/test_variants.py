import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import variants as V
from postmill.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    spots = defaultdict(set)  # a word and every way to leave one code point out
    for w in n:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            spots[key].add(w)
    nears = defaultdict(set)
    for ws in spots.values():
        for w in ws:
            nears[w] |= {x for x in ws if near(w, x)}
    forms = {}
    for w in n:
        if nears[w]:
            x = min(nears[w], key=lambda x: (-n[x], x))
            if n[x] >= 10 * n[w]:
                forms[w] = x
    out = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n[w], len(nears[w]), n[forms[w]] if w in forms else None))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    base = ["internet", "language", "Straßenbahn", "éléphant", "aaaaaaa", "abababab", "listens", "silents", "tinsels", "naïveté", "a×b÷cdef", "ÀÉÎÕÜßàé"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", " ", ".", "s", "1"]) for _ in range(120))) for i in range(80)]
    for i in range(300):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        rows.append((1000 + i, f"{w[:k]}{rng.choice('abé')}{w[k + rng.randrange(2):]} {w[:k]}{w[k + 1:]} x{w}, {w}x"))
    hot = " ".join(["frequent"] * 300 + ["frequens"] * 25 + ["freqqens"] * 2)
    rows += [(7, hot), (7, hot), (None, hot), (8, None), (None, None), (9, ""), (10, "日本語 123 __"), (11, "short words only"), (12, "z" * 5000 + " " + "z" * 5000)]
    return rows


def test_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, word string, key long").repartition(5)
    got = sorted(map(tuple, V.group_variants(docs).collect()), key=repr)
    assert got == brute(rows)
    assert any(f is not None and f != r for _, f, r, *_ in got)  # a chain of two forms or more


def test_random_words_over_few_letters(spark):
    """Many anagrams and shared signatures."""
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(60))) for i in range(120)]
    got = sorted(map(tuple, V.group_variants(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_near_words_share_a_signature():
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12)))
        k, c = rng.randrange(len(w)), rng.choice("abcxyzé")
        replaced, longer = w[:k] + c + w[k + 1:], w[:k] + c + w[k:]
        sums, lengths = V.parts_of(pa.array([w, replaced]), V.SAME_PARTS)
        same = V.signed(sums, 2, lengths)
        assert (same[0] == same[1]).any()
        sums, lengths = V.parts_of(pa.array([w, longer]), V.CROSS_PARTS)
        cross = V.signed(sums, 1, lengths + np.array([1, 0]))
        assert (cross[0] == cross[1]).any()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "lonesome"), (2, "lonesome lonesomes")]])
def test_tiny_tables(spark, rows):
    out = V.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, SF_SMALL).collect()), key=repr) == brute(rows)

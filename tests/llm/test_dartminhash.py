from collections import Counter

import numpy as np
import pytest

from postmill.llm import dartminhash as D
from postmill.llm.common import Scratch
from postmill.llm.graph import components
from postmill.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def shingles(text):
    w = D.WORD.findall(text.lower())
    if not w:
        return Counter([("whole", text.strip())])
    return Counter(tuple(w[i:i + D.SHINGLE]) for i in range(max(1, len(w) - D.SHINGLE + 1)))


def brute_classes(rows, least=D.SIMILARITY):
    """class id by comparing every two documents; rows are (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows if t is not None]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            total = (a | b).total()
            if (a & b).total() >= least * total:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i in label}


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    els = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    wb[:120] = wa[:120]
    k = 4000
    sig = D.signatures(np.concatenate([els, els]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, k)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    alone = D.signatures(els, wa, np.zeros(300, int), 1, k)
    assert (alone[0] == sig[0]).all()  # a signature does not depend on its batch


def test_tiny_sets_and_large_weights_fill_every_coordinate():
    sig = D.signatures(np.array([5, 5, 9], np.uint64), np.array([1.0, 1e6, 1.0]), np.array([0, 1, 2]), 3, 100)
    assert sig.shape == (3, 100) and (sig != 0).all()


def packed(text, shingler):
    e, n = np.unique(shingler.shingles(text), return_counts=True)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(D.salted(np.repeat(e, n), turn))


def test_shared_counts_give_weighted_similarities(monkeypatch):
    monkeypatch.setattr(D, "COLUMNS", 3)
    s = D.Shingler()
    texts = ["a b c d e f g", "a b c d e f h", "x y z w v " * 9, "x y z w v " * 7, "a", "", "!"]
    got = D.shared_counts([packed(t, s) for t in texts], [packed(t, s) for t in texts[::-1]])
    want = [[(shingles(a) & shingles(b)).total() for b in texts[::-1]] for a in texts]
    assert got.tolist() == want


def test_spanning_links_join_the_same_nodes():
    a, b = np.array([1, 2, 1, 3, 9]), np.array([2, 3, 3, 4, 8])
    assert D.spanning(a, b) == [(1, 2), (2, 3), (3, 4), (9, 8)]


@pytest.mark.parametrize("block,items", [(256, 1 << 30), (64, 1 << 19), (4, 1 << 30), (1, 1 << 30), (256, 2000)])
def test_large_family_in_blocks_of_any_size(spark, monkeypatch, block, items):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "BLOCK_ITEMS", items)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
    rows = []
    for i in range(90):  # copies of one text with 1 to 9 words changed: links at all similarities
        words = list(base)
        for at in rng.integers(0, 160, rng.integers(1, 10)):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.uid: r.class_id for r in D.near_duplicates(docs).collect()} == brute_classes(rows)


def test_components_of_paths_hubs_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_duplicates"](spark, SF_SMALL).collect()}
    assert got == brute_classes(rows)


def test_chains_copies_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(60):  # each differs from the one before in a few words: a chain of links
        base[(i * 37) % 300] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, "same words here in this text") for i in range(40)] + [(150, "SAME words, here: in this text!")]
    rows += [(200, None), (201, None), (202, ""), (203, "  "), (204, "###"), (205, "one two"), (206, "one two"), (207, "x " * 400), (208, "x " * 390)]
    want = brute_classes(rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in [*rows, rows[3], (None, "alone by itself")]], "doc_id long, text string, node long, uid long")
    got = D.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r.uid: r.class_id for r in got if r.uid >= 0} == want
    assert [r.uid == r.class_id for r in got if r.uid < 0] == [True]
    assert want[202] == want[203] == 202 and want[200] == 200 and want[201] == 201 and want[208] == 207


def test_very_long_texts_get_blocks_of_their_own(spark, monkeypatch):
    """Near copies of a very long text among short ones; blocks are bounded in items, too."""
    monkeypatch.setattr(D, "BLOCK_ITEMS", 50_000)
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 30_000, 120_000)]
    rows = []
    for i in range(6):
        words = list(base)
        for at in rng.integers(0, len(words), 300):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(10, " ".join(base[:200])), (11, " ".join(base[:199])), (12, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.uid: r.class_id for r in D.near_duplicates(docs).collect()} == {**{i: 0 for i in range(6)}, 10: 10, 11: 10, 12: 12}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.near_duplicates(docs).count() == 0


def test_shared_buckets_without_any_near_copy(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    rows = []
    for i in range(40):  # about 0.6 similar: they share buckets, none is a near copy
        words = list(base)
        for at in range(i % 7, 100, 18):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.uid: r.class_id for r in D.near_duplicates(docs).collect()} == brute_classes(rows)


def test_an_id_with_several_texts_is_several_documents(spark):
    rng = np.random.default_rng(11)
    a, b, c = ([f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(3))
    near = lambda words, at: " ".join([*words[:at], "other", *words[at + 1:]])
    rows = [(0, " ".join(a)), (1, " ".join(a)), (1, " ".join(b)), (1, near(b, 50)), (1, " ".join(c)), (7, near(c, 20)), (8, near(b, 90)), (9, "alone by itself"), (9, None)]
    rows += [(1, " ".join(f"w{x}" for x in rng.integers(0, 5000, 50))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    keys = docs.select("doc_id", "text", *D.node_key(docs["doc_id"], docs["text"])).collect()
    row = {(r.uid, r.k_text): r for r in got}
    res = [row[k.uid, k.k_text] for k in keys]
    want = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])  # each row is a document
    classes = {}
    for i, k in enumerate(keys):
        classes.setdefault(want[i], []).append(i)
    for members in classes.values():
        first = min(members, key=lambda i: (keys[i].uid, keys[i].k_text))
        assert [i for i in members if res[i].kept] == [first]
        assert {res[i].class_id for i in members} == {keys[first].uid}
    assert [r.exact_id for r in res[:3]] == [0, 0, 1]

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from postmill.llm import linededup as L
from postmill.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL


def brute(rows, min_docs=10, least=1):
    key = lambda x: x.strip(L.BLANKS).translate(L.FOLD)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    h[0, :500] = 7  # same first half: the second half still tells them apart
    n = rng.integers(2, 2**40, 20_000)
    t = L.PerfectHash.unpack(**L.PerfectHash.build(h[0], h[1], n).pack())
    assert sorted(t.slots(h[0], h[1])) == list(range(20_000))
    assert (t.lookup(h[0], h[1]) == np.minimum(n, 2**32 - 1)).all()
    assert not t.lookup(h[1], h[0]).any()


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = QUERIES["op2_line_dedup"](spark, SF_SMALL)
    res = con.execute(ORACLE["op2_line_dedup"])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("min_docs,least", [(2, 1), (3, 4), (10, 1)])
def test_brute_force_with_hot_lines_nulls_repeats(spark, min_docs, least):
    rows = [(i, f"own {i}\n  Shared LINE \x0b\nhot\n" + ("rare\n" if i % 9 == 0 else "") + f"tail {i % 5}\né{i % 3}") for i in range(60)]
    rows += [(1000, None), (None, None), (1001, ""), (None, "hot\nx"), (7, rows[7][1]), (7, rows[7][1]), (1002, "\n\n \n"), (1003, "hot\n" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, k long, dropped string")
    got = [(r.doc_id, r.line_n_lines, r.line_n_dropped, r.text) for r in L.dedup_lines(docs, min_docs=min_docs, least_chars=least).collect()]
    assert sorted(got, key=repr) == brute(rows, min_docs, least)


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, h1 string, shard int")
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "h1", "shard", "line_n_lines", "line_n_dropped"] and out.count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_a_line_in_half_of_all_documents_below_the_heavy_limit(spark, monkeypatch):
    """Its shard is met in copies; so are crowded shards of many keys."""
    monkeypatch.setattr(L, "HEAVY_KEYS", 1)     # nothing is heavy
    monkeypatch.setattr(L, "SHARD_PROBES", 20)
    monkeypatch.setattr(L, "LEAST_SHARDS", 4)
    rows = [(i, f"own {i}\n" + ("half\n" if i % 2 else "") + f"third {i % 3}\nrare {i // 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.line_n_lines, r.line_n_dropped, r.text) for r in L.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)
    counts, pairs = L.count_lines(docs, "text", 1)
    copies = {r.slot: r.copies for r in L.shard_copies(counts, -(-pairs // 20)).collect()}
    assert max(copies.values()) == 8  # 150 documents hold the line


def test_columns_named_like_the_new_ones_give_way(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y")], "doc_id long, text string, line_n_lines string, line_n_dropped string")
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "line_n_lines", "line_n_dropped"] and tuple(out.first()) == (1, "a\nb", 2, 0)

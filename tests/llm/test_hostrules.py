import random
import re

import duckdb
import pytest

from postmill.llm import hostrules as H
from postmill.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL


def brute_counts(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    spots = {}
    for i in range(len(ws) - 4):
        spots.setdefault(tuple(ws[i:i + 5]), []).append(i)
    hit = {p for at in spots.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def fails(c):
    return {"few_words": c["n_words"] < 10, "repeats": 100 * c["n_repeat_words"] > 20 * c["n_words"],
            "symbols": 100 * c["n_symbols"] > 10 * c["word_chars"], "dup_lines": 100 * c["n_dup_lines"] > 30 * c["n_lines"]}


def brute_hosts(rows):
    """(rate, low) by host and rule from (host, {rule: failed}) rows, by the definition."""
    hosts = {}
    for h, f in rows:
        hosts.setdefault(h, []).append(f)
    out = {h: {} for h in hosts}
    for rule in H.RULES:
        x = {h: (sum(f[rule] for f in fs), len(fs)) for h, fs in hosts.items()}
        n, mean = len(rows), sum(a for a, _ in x.values()) / len(rows)
        k = max(2, H.strength(sum(b * (a / b - mean) ** 2 for a, b in x.values()), sum(a * (1 - a / b) for a, b in x.values()), len(x), n,
                       sum(b * b for _, b in x.values())))
        for h, (a, b) in x.items():
            rate = (a + mean * k) / (b + k)
            out[h][rule] = rate, rate - 2 * (rate * (1 - rate) / (b + k + 1)) ** 0.5
    return out


ODD = ["", None, " \t\n", "one", "a b c d e a b c d e", "x " * 5000, "é日🙂 # $ | é日🙂\n" * 12, "a\x0bb\x0cc\rd\te f", "l\n l\nl\n\n\n", "a b c d",
       " ".join(f"w{i}" for i in range(11)), "p q r s t p q r s t p q r s t", "&" * 300, "1 2 3 4 5 " * 3 + " ".join(str(i) for i in range(90)),
       " ".join(f"long{i % 700}" for i in range(120_000))]


def test_counts_by_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "\t "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.c.asDict() for r in rows.select("i", H.counts(rows["t"]).alias("c")).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def corpus():
    """A hot clean host with a third of all rows, junk hosts large and small, a null host."""
    clean = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, clean(i), "hot") for i in range(200)]
    rows += [(1000 + i, clean(i) if i % 10 == 0 else clean(i) + " #$%" * 20, "junk") for i in range(60)]       # symbols
    rows += [(2000 + i, f"menu {i}\n" * 15 + clean(i) * 0 if i % 8 else clean(i), "menus") for i in range(40)]  # repeated lines
    rows += [(3000 + i, clean(i), f"h{i % 50}") for i in range(290)]
    rows += [(4000, clean(1) + " #$%" * 20, "lone")]                                                            # one bad row convicts nobody
    rows += [(None, clean(2), None), (None, None, None), (5000, "", "hot"), (5001, clean(3), "hot"), (5001, clean(3), "hot")]
    return rows


def test_verdicts_by_brute_force_with_hot_and_null_hosts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, h, 1, 2.0, "z") for i, t, h in rows],
                                 "doc_id long, text string, source string, host_n int, host_symbols double, kept string")
    got = H.judge(docs).collect()
    rates = brute_hosts([(h, fails(brute_counts(t))) for _, t, h in rows])
    assert len(got) == len(rows)
    want = sorted(((i, "=" + h if h is not None else "", base, any(low > 0.5 for _, low in rates[h].values())) for i, t, h in rows
                   for base in [fails(brute_counts(t))["few_words"] or fails(brute_counts(t))["repeats"]]), key=repr)
    assert sorted(((r.k_id, r.host, r.base_failed, r.host_failed) for r in got), key=repr) == want
    assert all(r.kept == (not r.base_failed and not r.host_failed) for r in got)
    for r in got:
        for rule, (rate, _) in rates[r.host[1:] if r.host else None].items():
            assert abs(r[f"host_{rule}"] - rate) < 1e-9
    assert {r.host for r in got if r.host_failed} == {"=junk", "=menus"}
    kept = H.keep_passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(r.k_id for r in got if r.kept and r.k_id is not None)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "s"), (1, "a b", "s")]])
def test_tiny_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert H.judge(docs).count() == len(rows) and H.keep_passing(docs).count() == 0


def test_query_matches_sql_and_stays_in_the_jvm(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = QUERIES["op11_host_rules"](spark, SF_SMALL)
    res = con.execute(ORACLE["op11_host_rules"])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
    counted = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = counted.select(H.counts(counted["text"]).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

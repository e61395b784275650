import math
import random

import numpy as np

from postmill.llm import quality as Q
from postmill.llm.queries import QUERIES
from tests.conftest import SF_CHECK


def brute(rows, prior):
    """Posteriors from (host, path, llr) rows, by the definition."""
    p = [1 / (1 + math.exp(-(x + prior))) for _, _, x in rows]
    group = lambda key: {k: [p[i] for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = group(lambda r: r[0]), group(lambda r: r[:2])
    mean = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
    rate = lambda v: sum(v) / len(v)

    def strength(groups, centre, dof):
        b = sum(len(v) * (rate(v) - centre(k)) ** 2 for k, v in groups.items())
        w = sum(len(v) * rate(v) * (1 - rate(v)) for v in groups.values())
        return Q.strength(b, w, dof, len(p), sum(len(v) ** 2 for v in groups.values()))

    kh = strength(hosts, lambda k: mean, len(hosts))
    kp = strength(paths, lambda k: rate(hosts[k[0]]), len(paths) - len(hosts) + 1)
    out = []
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for (h, q, x), own in zip(rows, p):
        hr = clip((sum(hosts[h]) - own + kh * mean) / (len(hosts[h]) - 1 + kh))
        pr = clip((sum(paths[h, q]) - own + kp * hr) / (len(paths[h, q]) - 1 + kp))
        out.append((hr, pr, 1 / (1 + math.exp(-(x + math.log(pr / (1 - pr)))))))
    return out




def test_hierarchy_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [("=h" if i % 3 == 0 else f"={rng.randint(0, 6)}", f"={rng.randint(0, 2)}", rng.gauss(1 if i % 3 else -2, 1)) for i in range(300)]
    scored = spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "k_id long, k_text long, host string, path string, llr double")
    rates, top = Q.site_rates(scored, 0.4)
    want = brute(rows, 0.4)
    got = {(r.host, r.path): r for r in rates.collect()}
    for (h, q, x), (hr, pr, _) in zip(rows, want):
        r, own = got[h, q], 1 / (1 + math.exp(-(x + 0.4)))
        mine = (r.host_s - own + top["host_strength"] * top["mean"]) / (r.host_n - 1 + top["host_strength"])
        assert abs(mine - hr) < 1e-9
        assert abs((r.path_s - own + top["path_strength"] * mine) / (r.path_n - 1 + top["path_strength"]) - pr) < 1e-9


def test_query_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.k_id: r.kept for r in Q.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [d for d in y if d % 2]
    good, bad = [d for d in held if y[d]], [d for d in held if not y[d]]
    assert sum(got[d] for d in good) / len(good) > 0.97
    assert sum(not got[d] for d in bad) / len(bad) > 0.7
    full = QUERIES["op6_quality"](spark, SF_CHECK)
    assert full.columns == ["doc_id", "llr", "host_rate", "path_rate", "posterior", "kept"] and full.count() == docs.count()


def test_nulls_repeats_no_labels_and_empty_tables(spark):
    rows = [(1, "good text here", "a", "en", 0.5), (2, None, None, None, 0.1), (None, "", "a", None, 0.2), (3, "x", "b", "en", 0.3), (3, "x", "b", "en", 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, llr double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 5 and all(r.kept for r in got)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    both = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert len(Q.classify(docs, both).collect()) == 5
    assert Q.classify(docs.limit(0), both).count() == 0


def test_strength_limits():
    assert Q.strength(0.0, 10.0, 5, 100, 2000) > 1e5  # no difference between groups: full shrinkage
    assert Q.strength(20.0, 0.1, 5, 100, 2000) < 1.0
    assert Q.strength(1.0, 1.0, 1, 100, 1e4) == 1e6


def test_features_have_fixed_size_and_see_repetition():
    f = Q.Features()
    assert f.vector(None).shape == f.vector("a b").shape == (Q.Features.size,)
    assert f.vector("so so so so")[3] > f.vector("so we go on")[3]
    assert np.isfinite(f.vector("é日🙂 " * 9)).all()

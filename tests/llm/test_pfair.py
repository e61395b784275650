from collections import Counter, defaultdict

import pytest

from postmill.llm import pfair as P


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1e-9, "c": 0.33, "d": 7}, {str(i): i + 1 for i in range(23)}])
def test_period_keeps_every_source_within_one_block(weights):
    shares = P.slot_shares(weights, 100)
    slots = P.edf_period(shares) * 3
    period = sum(shares.values())
    got = Counter()
    for t, s in enumerate(slots, 1):
        got[s] += 1
        assert all(abs(got[x] * period - shares[x] * t) < period for x in shares)


def brute(sizes, shares, block):
    """Slot of each (source, block) by running the scheduler over absolute releases and deadlines."""
    period, done, out, t = sum(shares.values()), Counter(), {}, 0
    n_blocks = {s: -(-n // block) for s, n in sizes.items()}
    while any((s, n_blocks[s] - 1) not in out for s in sizes):
        ready = [(-(-(done[s] + 1) * period // shares[s]), s) for s in shares if done[s] * period // shares[s] <= t]
        _, s = min(ready)
        out[s, done[s]] = t
        done[s] += 1
        t += 1
    return out


def test_mix_matches_brute_force(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else ["a", "b", None][i // 3 % 3], i) for i in range(900)] + [(5, "t5", "hot", 0), (None, None, "hot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, share long")
    got = P.mix(docs, block_docs=8, period=30).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.source, r.share) for r in got) == Counter((r[0], r[2], r[3]) for r in rows)
    key = lambda s: "" if s is None else "=" + s
    sizes = Counter(key(r[2]) for r in rows)
    shares = P.slot_shares({s: n**P.ALPHA for s, n in sizes.items()}, 30)
    want = brute(sizes, shares, 8)
    assert {(key(r.source), r.mix_block): r.mix_slot for r in got} == {k: v for k, v in want.items() if k[1] < -(-sizes[k[0]] // 8)}
    places = defaultdict(list)
    for r in got:
        places[key(r.source), r.mix_block].append(r.mix_offset)
    for (s, b), offsets in places.items():
        assert sorted(offsets) == list(range(min(8, sizes[s] - 8 * b)))
    ordered = P.in_mix_order(P.mix(docs, block_docs=8, period=30)).collect()
    assert [(r.mix_slot, r.mix_offset) for r in ordered] == sorted((r.mix_slot, r.mix_offset) for r in got)


def test_given_weights_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "x", "ab"[i % 2], 1) for i in range(64)], "doc_id long, text string, source string, n long")
    got = P.mix(docs, {"a": 3, "b": 1}, block_docs=1, period=8).collect()
    first = Counter(r.source for r in got if r.mix_slot < 8)
    assert first == {"a": 6, "b": 2} or first == {"a": 5, "b": 3}
    assert P.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.slot_shares({"a": 0})


@pytest.mark.parametrize("weights", [{str(i): 1.0 if i else 9.5 for i in range(20)}, {str(i): 1.0 if i else 99.5 for i in range(200)},
                                     {str(i): (i + 1) ** 0.5 for i in range(300)}, {"a": 1 / 3, "b": 1e-6, "c": 2 / 3}])
def test_blocks_stay_within_one_block_of_the_weights(weights):
    names, total, got, t = list(weights), sum(weights.values()), Counter(), 0
    for s, b, slot in P.Blocks(list(weights.values()), [10**9] * len(weights)).step(20_000):
        assert (b, slot) == (got[s], t)
        got[s], t = got[s] + 1, t + 1
        if t % 97 == 0 or t > 19_990:
            assert all(abs(got[k] - t * weights[x] / total) < 1 + 1e-6 for k, x in enumerate(names))


def test_default_mix_follows_the_weights_over_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 100)
    sources = ["big"] * 2100 + [f"s{i % 199}" for i in range(4200)]
    docs = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    sizes = Counter(sources)
    weights = {s: (1 / 3 if s == "big" else 2 / 3 / 199) for s in sizes}
    got = P.mix(docs, weights, block_docs=1).collect()
    assert len(got) == len(sources) and len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    for r in got:  # block j lies in its window, whatever ran out before
        w = weights[r.source] / sum(weights.values())
        assert r.mix_block / w - 1 - 1e-6 < r.mix_slot < (r.mix_block + 1) / w + 1e-6
    assert abs(sum(r.source == "big" and r.mix_slot < 3000 for r in got) - 1000) <= 1
    assert {s: n for s, n in Counter(r.source for r in got).items()} == sizes
    blocks = P.mix(docs, weights, block_docs=16).collect()
    assert all(r.mix_offset < 16 for r in blocks) and len({(r.mix_slot, r.mix_offset) for r in blocks}) == len(blocks)
    slot = {(r.source, r.mix_block): r.mix_slot for r in blocks}
    assert len(set(slot.values())) == len(slot) == sum(-(-n // 16) for n in sizes.values())


def test_whole_slots_are_apportioned_by_weight():
    assert P.slot_shares({"a": 3, "b": 1}, 8) == {"a": 6, "b": 2}
    assert P.slot_shares({str(i): 1 if i else 99.5 for i in range(200)}, 1000)["0"] in (333, 334)
    assert P.slot_shares({"a": 1, "b": 1e-9}, 10) == {"a": 9, "b": 1}


def test_columns_named_like_the_new_ones_give_way(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], "x", "y") for i in range(40)], "doc_id long, text string, source string, mix_slot string, mix_offset string")
    out = P.in_mix_order(P.mix(docs, block_docs=4))
    assert out.columns == ["doc_id", "text", "source", "mix_block", "mix_slot", "mix_offset"] and out.count() == 40

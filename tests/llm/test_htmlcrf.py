import html
import itertools
import re
import time

import numpy as np
import pytest

from postmill.llm import htmlcrf as H
from postmill.llm.htmlblocks import leaf_blocks
from postmill.llm.queries import QUERIES
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def chain():
    return H.Chain().fit([(H.features(leaf_blocks(h)), s) for h, s in H.labelled_pages(300)])


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks_of_broken_and_odd_markup():
    assert texts("<p><b>one<br>two<p>three &amp; &eacute;&#8364;</p>four") == ["one two", "three & é€", "four"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><title>no</title><!-- <p>no --><p>a<i>b</i> c") == ["ab c"]
    assert texts("a < b <3 <p class='x>y'>in</p><![CDATA[x]]>") == ["a < b <3", "in"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts(None) == texts("") == texts("<div> \n&nbsp;</div>") == []
    assert texts("<script>never closed <p>x") == [] and texts("<p title='never closed>x</p><p>y") == ["x", "y"]
    b = leaf_blocks("<div class='sideBar main'><p>x <a href=#>yy</a></p></div>")[0]
    assert b.path == ("div", "p") and b.names == {"side", "bar", "main"} and b.links == 2


def test_formulas_drawings_and_raw_text():
    assert texts("<p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be 1.</p>") == ["Let x be 1."]
    assert texts("<p>a <svg><title>t</title><text>n</text></svg> b</p><svg/>c") == ["a b", "c"]
    assert texts("<p>a<svg><path d='1'><p>rest of the page</p><div>more</div>") == ["a", "rest of the page", "more"]
    assert texts("<p>f <math><mi>y</mi><p>next</p>") == ["f y", "next"] and leaf_blocks("<p>f <math><mi>y<p>next")[1].path == ("p",)
    assert texts("<xmp>a &lt; <b>x</b></xmp><p>after") == ["a &lt; <b>x</b>", "after"] and texts("<xmp>open") == ["open"]
    assert texts("<noscript><p>hello</p></noscript> tail") == ["hello", "tail"]


def test_very_long_pages_take_linear_time():
    began = time.time()
    for page in ("<p>x" * 50_000, "<" * 200_000, "<a '" * 50_000, "<!--" * 50_000, "x" * 2_000_000, "</p>" * 50_000, "<script>" * 20_000,
                 "<b>" * 50_000 + "<p>x</p>" * 50_000, "<div>" * 50_000 + "x", "<a '>" * 50_000, "<svg>" * 50_000, "<svg><p>" * 50_000,
                 "<math>" * 50_000 + "<p>x" * 50_000, "<xmp>" * 50_000):
        leaf_blocks(page)
    assert time.time() - began < 30


def test_viterbi_and_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    c = H.Chain()
    c.w, c.step, c.start = rng.standard_normal(H.SIZE), rng.standard_normal((2, 2)), rng.standard_normal(2)
    rows = [list(rng.integers(0, H.SIZE, 5)) for _ in range(7)]
    e = c.emissions(rows)

    def score(path):
        return c.start[path[0]] + sum(e[i] for i, s in enumerate(path) if s) + sum(c.step[a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product((0, 1), repeat=7))
    assert c.decode(rows) == list(max(paths, key=score))
    weights = np.exp([score(p) for p in paths])
    want = (weights[:, None] * np.array(paths)).sum(axis=0) / weights.sum()
    full = np.zeros((1, 7, 2))
    full[0, :, 1] = e
    p, pairs, first = c._marginals(full, np.ones((1, 7), bool))
    assert np.allclose(p[0], want) and abs(pairs.sum() - 6) < 1e-9 and abs(first.sum() - 1) < 1e-9


def test_held_out_accuracy(chain):
    right = total = 0
    for page, states in H.labelled_pages(150, seed=77):
        got = chain.decode(H.features(leaf_blocks(page)))
        right, total = right + sum(a == b for a, b in zip(got, states)), total + len(states)
    assert right / total > 0.98


def articles_found(rows, pages):
    same = 0
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        plain = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        same += r.text == "\n\n".join(filter(None, plain))
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
    return same / len(rows)


def test_articles_of_pages_that_were_not_learned_from(spark):
    table = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    pages = {r.page_id: r for r in table.collect()}
    got = H.extract(table.filter("page_id % 2 = 1"), H.train(table.filter("page_id % 2 = 0"))).collect()
    assert len(got) == sum(k % 2 for k in pages) and articles_found(got, pages) > 0.99


def test_query_returns_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()}
    got = QUERIES["op3_main_text"](spark, SF_CHECK).collect()
    assert len(got) == len(pages) and articles_found(got, pages) > 0.99


def test_nulls_repeats_clashes_and_empty_tables(spark, chain):
    page = "<body><nav><ul><li><a href=/>a b</a></ul></nav><article><h1>Some title here</h1><p>One long sentence, with words in it. And another one.</p></article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "", "t"), (3, None, page, "t"), (3, None, page, "t"), (None, "u", "<script>x</script>", "t")],
                                  "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(pages, chain).collect())
    want = "Some title here\n\nOne long sentence, with words in it. And another one."
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, want, len(want)), (3, want, len(want))]
    assert H.extract(pages.limit(0), chain).count() == 0
    assert isinstance(H.train(pages.limit(0), built=30), H.Chain)

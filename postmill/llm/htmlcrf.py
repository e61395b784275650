"""Main-text extraction by a linear-chain conditional random field (operator 3).

A page is the sequence of its leaf blocks. A block's features are its ancestors' tags,
the words of their classes, ids and roles, and facts about its text (length, links,
punctuation, place in the page). Two states, article text and everything else, form a
chain; weights are fitted by maximum likelihood with forward-backward on labelled
pages, and pages are decoded by Viterbi.

Labelled pages are built by ``labelled_pages`` from rules for the parts of a web page
(the fixed lists below name how sites mark them up), joined by a bounded sample of the
given pages whose own article or main element labels their blocks.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from postmill.llm.common import hash_sample, slices
from postmill.llm.htmlblocks import Block, leaf_blocks

SIZE = 1 << 14
BUILT, SAMPLE = 800, 200   # labelled pages: built by rule; given ones, at most
SAMPLE_CHARS = 100_000     # longest given page to learn from; longer ones are only decoded
STEPS, RATE, RIDGE = 150, 0.05, 1e-4
OTHER_PARTS = frozenset("nav aside footer form dialog menu button select search".split())


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of each block of a page."""
    out, total = [], len(blocks)
    before: Block | None = None
    for i, b in enumerate(blocks):
        words = b.text.split()
        n, links = len(words), b.links / len(b.text)
        size = sum(n > x for x in (1, 2, 4, 8, 15, 30, 60))
        rate = sum(links > x for x in (0.0, 0.25, 0.5, 0.9))
        ends = b.text[-1] if b.text[-1] in ".!?:;,|»>" else "w"
        f = [f"t:{t}" for t in set(b.path)] + [f"n:{w}" for w in b.names] + [f"k:{w}" for w in b.near]
        f += ["bias", f"leaf:{b.path[-1] if b.path else ''}", f"up:{'/'.join(b.path[-2:])}", f"size:{size}", f"links:{rate}",
              f"size+links:{size},{rate}", f"ends:{ends}", f"leaf+size:{b.path[-1] if b.path else ''},{size}",
              f"commas:{min(3, b.text.count(','))}", f"start:{min(i, 4)}", f"stop:{min(total - 1 - i, 4)}", f"capital:{b.text[0].isupper()}"]
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if b.hidden:
            f.append("hidden")
        if b.path and b.path[-1] != "a" and any(t in ("h1", "h2", "h3") for t in b.path):
            f.append("heading")
        if before is not None:
            f.append("same" if before.path == b.path else "other")
        out.append([zlib.crc32(x.encode()) % SIZE for x in f])
        before = b
    return out


class Chain:
    """Weights of the field: a score for state 1 per feature, and for each step between states."""

    def __init__(self):
        self.w = np.zeros(SIZE)
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.w[r].sum() for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most probable states (Viterbi); equal paths prefer state 0."""
        if not rows:
            return []
        s, back = self.start.copy(), []
        e = self.emissions(rows)
        s = [self.start[0], self.start[1] + e[0]]
        (aa, ab), (ba, bb) = self.step.tolist()
        for x in e[1:].tolist():
            from0, from1 = s[1] + ba > s[0] + aa, s[1] + bb > s[0] + ab
            back.append((int(from0), int(from1)))
            s = [max(s[0] + aa, s[1] + ba), max(s[0] + ab, s[1] + bb) + x]
        path = [int(s[1] > s[0])]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]]) -> Chain:
        """Maximum likelihood with a ridge, by Adam on exact gradients."""
        pages = [p for p in pages if p[0]]
        longest = max(len(x) for x, _ in pages)
        y = np.zeros((len(pages), longest), int)
        mask = np.zeros((len(pages), longest), bool)
        for i, (_, states) in enumerate(pages):
            y[i, :len(states)], mask[i, :len(states)] = states, True
        flat = np.concatenate([np.array(r) for x, _ in pages for r in x])
        lens = np.array([len(r) for x, _ in pages for r in x])
        row = np.repeat(np.arange(len(lens)), lens)
        gold = y[mask]
        pair = (y[:, :-1] * 2 + y[:, 1:])[mask[:, 1:]]
        n = len(pages)
        params = np.zeros(SIZE + 6)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, STEPS + 1):
            self.w, self.step, self.start = params[:SIZE], params[SIZE:SIZE + 4].reshape(2, 2), params[SIZE + 4:]
            e = np.zeros((n, longest, 2))
            e[..., 1][mask] = np.bincount(row, self.w[flat], len(lens))
            p, pairs, first = self._marginals(e, mask)
            g = np.zeros_like(params)
            g[:SIZE] = np.bincount(flat, (p[mask] - gold)[row], SIZE)
            g[SIZE:SIZE + 4] = pairs - np.bincount(pair, minlength=4)
            g[SIZE + 4:] = first - np.bincount(y[:, 0], minlength=2)
            g = g / n + RIDGE * params
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.step, self.start = params[:SIZE].copy(), params[SIZE:SIZE + 4].reshape(2, 2).copy(), params[SIZE + 4:].copy()
        return self

    def _marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of state 1 at each place, expected step counts, expected first states."""
        n, length, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = self.start + e[:, 0]
        for t in range(1, length):
            x = np.logaddexp(a[:, t - 1, 0, None] + self.step[0], a[:, t - 1, 1, None] + self.step[1]) + e[:, t]
            a[:, t] = np.where(mask[:, t, None], x, a[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = e[:, t + 1] + b[:, t + 1]
            x = np.logaddexp(self.step[None, :, 0] + nxt[:, 0, None], self.step[None, :, 1] + nxt[:, 1, None])
            b[:, t] = np.where(mask[:, t + 1, None], x, 0.0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a[..., 1] + b[..., 1] - z[:, None])
        joint = np.exp(a[:, :-1, :, None] + self.step + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        return p, joint.sum(axis=(0, 1)).ravel(), np.exp(a[:, 0] + b[:, 0] - z[:, None]).sum(axis=0)


# How sites mark up the parts of a page. Each entry is an opening tag.
ARTICLE = ["article", "main", "div class=content", "div id=content", "div class=article-body", "div class='post entry'", "div class=entry-content", "div class=story",
           "section class=post-content", "div id=main", "div role=main", "div itemprop=articleBody class=text", "div", "td"]
PARTS = {
    "nav": ["nav", "div class=menu", "div id=nav", "ul class=navigation", "div role=navigation", "div class=breadcrumb", "div class='main-menu navbar'"],
    "header": ["header", "div id=header", "div class=masthead", "div class=site-header", "div role=banner", "div class=topbar"],
    "footer": ["footer", "div id=footer", "div class=site-footer", "div role=contentinfo", "div class=bottom", "div class=copyright"],
    "side": ["aside", "div id=sidebar", "div class=sidebar", "div class='widget related'", "div class=recommended", "section class=related-posts", "div role=complementary"],
    "notice": ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=alert", "div class='consent popup'", "div role=alert", "dialog", "div class=modal"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div id=banner-ad", "div class=promo"],
    "form": ["form", "form class=search", "div class=newsletter", "form id=subscribe", "div class='login form'", "form class=comment-form", "div class=signup"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "section id=responses", "div class='comment reply'"],
    "share": ["div class=share", "div class=social", "ul class=social-links", "div class=tags", "div class=byline-share"],
}


def labelled_pages(count: int, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """(html, states of its leaf blocks), built from random parts whose state is known.
    Pages whose parts parse differently together than apart are left out."""
    rng = random.Random(seed)
    syllables = [a + b for a in ("", *"bcdfglmnprstv") for b in "aeiou"]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join((words(4, 14) + rng.choice(["", ", " + words(3, 8)])).capitalize() + rng.choice("...?!") for _ in range(rng.randint(low, high)))

    def element(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(rng.randint(low, high))) + "</ul>"

    def paragraph() -> str:
        text = sentences(1, 6) if rng.random() < 0.8 else words(1, 6)
        if rng.random() < 0.2:
            text = text.replace(" ", f" <a href='#'>{word()}</a> ", 1)
        return rng.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<p><b>{}<br>", "<p>{}<br></p>"]).format(text)

    def other(kind: str) -> str:
        inner = {
            "nav": lambda: links(3, 9),
            "header": lambda: rng.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", links(2, 5), words(1, 4)]),
            "footer": lambda: rng.choice([f"&copy; {words(1, 3)} &middot; {sentences(1, 1)}", links(2, 6) + f"<p>&copy; 20{rng.randint(10, 25)} {words(1, 4)}</p>", f"<p>{sentences(1, 2)}</p>"]),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice([links(3, 8), f"<p>{sentences(1, 3)}</p>", "".join(f"<p>{sentences(1, 2)}</p>" for _ in range(3))]),
            "notice": lambda: rng.choice([f"<p>{sentences(1, 3)}</p><button>{word()}</button>", sentences(1, 2)]),
            "ad": lambda: rng.choice([sentences(1, 2), f"<p>{sentences(1, 3)}</p>", f"<a href='#'>{words(2, 6)}</a>", f"<h4>{words(1, 4)}</h4>{sentences(1, 2)}"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q>" + rng.choice([f"<button>{word()}</button>", f"<p>{sentences(1, 1)}</p>", f"<select><option>{word()}<option>{word()}</select>"]),
            "comments": lambda: f"<h2>{words(1, 3)}</h2>" + "".join(f"<div class=comment><span class=author>{words(1, 2)}</span><p>{sentences(1, 4)}</p></div>" for _ in range(rng.randint(1, 5))),
            "share": lambda: links(2, 4),
        }[kind]()
        return element(rng.choice(PARTS[kind]), inner)

    for _ in range(count):
        parts: list[tuple[int, str]] = [(0, other(k)) for k in ("notice", "header", "nav", "ad", "form", "share") if rng.random() < 0.45]
        rng.shuffle(parts)
        body = [(1, f"<h1>{words(3, 10)}</h1>")] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            body.append((1, rng.choices([paragraph, lambda: f"<h2>{words(2, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{words(3, 14)}</li>" for _ in range(3)) + "</ul>",
                                         lambda: f"<blockquote>{paragraph()}</blockquote>", lambda: f"<pre>{words(4, 20)}</pre>"], [20, 2, 1, 1, 0.3])[0]()))
            if rng.random() < 0.05:
                body.append((0, other(rng.choice(["ad", "share", "side", "form"]))))
        if rng.random() < 0.15:
            body.append((0, other(rng.choice(["comments", "share"]))))
        after = [(0, other(k)) for k in ("side", "comments", "form", "ad", "nav", "notice", "footer") if rng.random() < 0.45]
        opening = rng.choice(ARTICLE)
        wrap = rng.choice(["", "", "div class=wrapper", "div id=page"])
        html, states = "<!DOCTYPE html><html><head><title>x</title></head><body>" + (f"<{wrap}>" if wrap else ""), []
        for where in (parts, [(None, f"<{opening}>")], body, [(None, f"</{opening.split()[0]}>")], after):
            for state, piece in where:
                html += piece
                if state is not None:
                    states += [state] * len(leaf_blocks(piece))
        html += (f"</{wrap.split()[0]}>" if wrap else "") + "</body></html>"
        if len(leaf_blocks(html)) == len(states):
            yield html, states


def own_labels(blocks: list[Block]) -> list[int] | None:
    """States from a page's own article or main element; None without one."""
    inside = ["article" in b.path or "main" in b.path for b in blocks]
    if not any(inside):
        return None
    return [int(x and not OTHER_PARTS & set(b.path)) for x, b in zip(inside, blocks)]


def train(pages: DataFrame, html_col: str = "html", built: int = BUILT, sample: int = SAMPLE) -> Chain:
    """Fit on ``built`` pages made by rule and at most ``sample`` of the given ones of up to
    SAMPLE_CHARS characters, the first by a hash."""
    data = [(features(leaf_blocks(h)), s) for h, s in labelled_pages(built)]
    chosen = pages.select(pages[html_col].cast("string").alias("h")).filter(F.length("h") <= SAMPLE_CHARS)
    chosen = hash_sample(chosen, "h", sample, pages.count())
    for r in chosen.collect():
        blocks = leaf_blocks(r["h"])
        states = own_labels(blocks)
        if states:
            data.append((features(blocks), states))
    return Chain().fit(data)


def main_text(page: str | None, chain: Chain) -> str:
    """The article's blocks in page order, two line breaks between them."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, s in zip(blocks, chain.decode(features(blocks))) if s)


def extract(pages: DataFrame, chain: Chain, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, then ``text`` and ``n_chars`` (its code points).

    Whole pages; null and empty pages and those without an article give an empty text.
    Repeated rows repeat; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain)
    src = pages.select(*keep, pages[html_col].cast("string").alias("_html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, n = shared.value, len(keep)
        for batch in batches:
            for start, size in slices(batch.column(n)):
                part = batch.slice(start, size)
                texts = [main_text(h, chain) for h in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)

"""Leaf blocks of HTML pages: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes svg annotation annotation-xml".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup
    option p pre search section select summary table tbody td tfoot th thead tr ul xmp""".split())
# An element of the key kind ends open elements of these kinds, up to one of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
NO_P = BLOCK - {"button", "caption", "label", "legend", "option", "optgroup", "select", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "head", "html"}

FOREIGN = frozenset(("svg", "math"))  # an unclosed one ends at the next block tag
SVG_END = re.compile(rf"</svg\b[^>]*(?:>|\Z)|(?=</?(?:{'|'.join(sorted(BLOCK))})[\s/>])", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
TAG_ANY = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
DEEPEST = 512  # open elements; deeper ones add no ancestor, their text stays, as in browsers
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """A leaf block: its text, the open elements around it, and how much of it is links."""

    text: str
    path: tuple[str, ...]
    names: frozenset[str]
    near: frozenset[str] = frozenset()  # of the closest ancestor that has any
    links: int = 0
    hidden: bool = False


@dataclass
class _Page:
    stack: list[tuple[str, frozenset[str], bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    depth_a: int = 0
    foreign: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            names = frozenset().union(*(n for _, n, _ in self.stack))
            self.blocks.append(Block(text, tuple(t for t, _, _ in self.stack), names,
                                     next((n for _, n, _ in reversed(self.stack) if n), frozenset()), min(self.linked, len(text)), any(h for _, _, h in self.stack)))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.depth_a:
            self.linked += len(text)

    def pop_to(self, k: int) -> None:
        for tag, _, _ in self.stack[k:]:
            self.depth_a -= tag == "a"
            self.foreign -= tag in FOREIGN
        del self.stack[k:]

    def close_open(self, kinds: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in kinds:
                self.pop_to(k)
                return
            if self.stack[k][0] in stops:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK or tag == "br":
            if tag == "br":
                self.parts.append(" ")
                return
            self.flush()
            if self.foreign:
                self.pop_to(next(k for k, (t, _, _) in enumerate(self.stack) if t in FOREIGN))
            if tag in NO_P:
                self.close_open({"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
        if tag in VOID or len(self.stack) >= DEEPEST:
            return
        names = frozenset(w.lower() for m in NAMED.finditer(attributes) for w in WORDS.findall(m[2] or m[3] or m[4] or "")) if attributes else frozenset()
        self.stack.append((tag, names, bool(attributes) and HIDDEN.search(attributes) is not None))
        self.depth_a += tag == "a"
        self.foreign += tag in FOREIGN

    def close(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                return
            if not block and self.stack[k][0] in BLOCK:
                return


@lru_cache(maxsize=None)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


def leaf_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, titles, drawings and comments hold none.

    Formulas are text like any other and `noscript` is an element like any other, for the
    reader of the blocks to judge; `xmp` holds its text as written. An unclosed drawing
    ends at the next block tag. Character references are decoded, white space inside a
    block becomes one space.
    Runs in time linear in the page for any input.
    """
    out, at, page, tag_at = _Page(), 0, page or "", TAG
    last = page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            out.add(page[at:])
            break
        if start > at:
            out.add(page[at:start])
        if start > last and page[start + 1:start + 2].replace("/", "a").isalpha():
            break  # a tag that the page's end cuts off
        m = tag_at.match(page, start)
        if m is None and tag_at is TAG and page[start + 1:start + 2].replace("/", "a").isalpha() and (m := TAG_ANY.match(page, start)):
            tag_at = TAG_ANY  # a quote that is never closed: from here on tags end at the first >
        if m is None:
            m = OTHER.match(page, start)
            if m is None:
                out.add("<")
                at = start + 1
            else:
                at = m.end()
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            out.close(tag)
        elif tag == "xmp":
            end = raw_end(tag).search(page, at)
            out.open(tag, m[3])
            out.parts.append(page[at:end.start() if end else len(page)])
            out.close(tag)
            at = end.end() if end else len(page)
        elif tag in RAW:
            if tag != "svg":
                end = raw_end(tag).search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].rstrip().endswith("/"):
                end = SVG_END.search(page, at)
                at = end.end() if end else len(page)
        else:
            out.open(tag, m[3])
    out.flush()
    return out.blocks

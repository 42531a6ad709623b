"""Operator 5: main text of HTML pages by a conditional random field over leaf blocks.

A page is a sequence of leaf blocks; each has features of its ancestors (elements, words of class and
id names), of its text (length, links, punctuation, signs of notices) and of its place. The field has two
labels, text and rest; it is trained once, on the driver, on labelled pages of many layouts (see
training_pages), whose number is a parameter, and decoded by Viterbi in every task. Pages are independent,
so nothing is shuffled and no host can be hot.

Defined results: a null, empty or unreadable html has the empty text; all blocks decoded as text are
joined in page order; nothing is dropped for its length or depth; labels of equal score are the rest; repeated rows
count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, spread
from .crf import ChainCRF
from .htmlblocks import Block, Node, blocks, name_parts

PAGES = 1000
CACHE_PATHS = 20_000

_DATE = re.compile(r"\b(?:19|20)\d\d\b|\d{1,2}[./:-]\d{1,2}")


def element_features(tag: str, names: str) -> set[str]:
    """What an element adds to the features of all blocks inside of it."""
    return {f"in:{tag}"} | {f"name:{p}" for p in (name_parts(names) if names else ())}


def path_features(node: Node | None) -> set[str]:
    """Features of a block's ancestors; formatting elements count as parents only."""
    out: set[str] = set()
    innermost = ""
    for tag, names in node.path() if node else ():
        out |= element_features(tag, names)
        innermost = names or innermost
    if node:
        out.add(f"parent:{node.tag}")
    return out | {f"near:{p}" for p in name_parts(innermost)}


def text_features(b: Block, at: int, n: int) -> set[str]:
    words = b.text.count(" ") + 1
    out = {"bias", f"words:{min(6, words.bit_length())}", f"linked:{min(4, 4 * b.linked // max(1, len(b.text)))}"}
    if b.text[-1] in ".!?…:;\"'”»":
        out.add("ends:sentence")
    if "©" in b.text or "(c)" in b.text:
        out.add("has:copyright")
    if "·" in b.text or "»" in b.text:
        out.add("has:dot")
    if words < 12 and _DATE.search(b.text):
        out.add("has:date")
    if at == 0:
        out.add("place:first")
    if at == n - 1:
        out.add("place:last")
    return out


# --- labelled pages -------------------------------------------------------------------------

#: Words that class and id names of layouts are made of.
TEXT_NAMES = "article content main post entry story body text page single blog news richtext prose copy markdown document section wrapper container column primary hentry".split()
REST_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs skip links topbar".split(),
    "header": "header masthead banner branding logo top site toolbar".split(),
    "footer": "footer bottom copyright legal colophon credits imprint".split(),
    "side": "sidebar aside widget related recommended trending popular promo teaser more rail recent tags cloud archive".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promotion adsense dfp banner commercial".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy disclaimer message toast paywall subscribe".split(),
    "form": "form newsletter signup login search subscribe contact register".split(),
    "comments": "comments comment disqus replies reply respond discussion thread reviews commentlist".split(),
    "share": "share social sharing buttons follow actions print meta byline author".split(),
}
NEUTRAL_NAMES = "box area wrap item list block x1 container wrapper section inner content body text row col widget module".split()
_SYLLABLES = "an be ca do en fa go hi in ja ka lo mi no or pa qui ra si to un va we xe ya zu ér eau üb ñan ción lich ing the".split()


def _sentence(r: random.Random, low: int, high: int, junk: float = 0.0) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    if r.random() < junk:
        words = [w + r.choice(["%%%", "###", "***", "&amp;&amp;", " |", "$$$", " &middot;"]) for w in words]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?", "", ","])


class _Writer:
    """Writes a page and the label of each piece of text."""

    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []

    def put(self, tag: str, text: str, label: int, inside: str = "") -> None:
        if not label and self.r.random() < 0.12:
            text = f"<b>{text}</b>" if self.r.random() < 0.5 else f"<b>{text}<br>"
        close = f"</{tag}>" if tag not in ("p", "li") or self.r.random() < 0.8 else ""
        self.html.append(f"<{tag}{inside}>{text}{close}")
        self.labels.append(label)

    def name(self, words: list[str]) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(words)
        if r.random() < 0.5:
            name += r.choice(["-", "_", "-", ""]) + r.choice([*words, *NEUTRAL_NAMES]).title()
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, label: int = 0) -> None:
        for _ in range(self.r.randint(1, 8)):
            self.put("li", f'<a href="/x">{_sentence(self.r, 1, 3)}</a>', label)

    def rest(self, kind: str) -> None:
        r, h = self.r, self.html
        names = self.name(REST_NAMES[kind])
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "div", "section"], "notice": ["div", "dialog", "section"], "form": ["form"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}[kind]
        tag = r.choice(tag)
        if tag in ("div", "section", "ol", "ul") and not names:
            names = f' class="{r.choice(REST_NAMES[kind])}"'
        h.append(f"<{tag}{names}>")
        if r.random() < 0.3:  # text of the element itself
            sign = r.choice(["&copy; example.com &middot; ", "&copy; ", ""]) if kind == "footer" else r.choice(["", "", "&raquo; "])
            h.append(sign + _sentence(r, 1, 25))
            self.labels.append(0)
            if r.random() < 0.5:
                h.append(f"</{tag}>")
                return
            h.append("<hr>")
        if kind in ("nav", "share"):
            h.append("<ul>")
            self.links()
            h.append("</ul>")
        elif kind == "header":
            self.put(r.choice(["div", "p", "h1", "h2", "span"]), _sentence(r, 1, 4), 0)
            if h[-1].startswith("<span"):
                h.append("<hr>")
        elif kind == "footer":
            self.put(r.choice(["p", "div"]), r.choice(["&copy; ", "© ", "&copy; 2024 ", ""]) + _sentence(r, 1, 12), 0)
        elif kind == "form":
            self.put("label", _sentence(r, 1, 3), 0)
            h.append('<input name="q">')
            h.append("<hr>")
            self.put("button", _sentence(r, 1, 2), 0)
            if r.random() < 0.5:
                self.put("p", _sentence(r, 4, 20), 0)
        elif kind == "comments":
            for _ in range(r.randint(1, 4)):
                self.put(r.choice(["p", "div", "li"]), _sentence(r, 3, 40), 0)
        else:
            if r.random() < 0.5:
                self.put(r.choice(["h3", "h4", "p"]), _sentence(r, 1, 4), 0)
            for _ in range(r.randint(1, 3)):
                self.put(r.choice(["p", "div"]), _sentence(r, 2, 30), 0)
            if r.random() < 0.4:
                h.append("<ul>")
                self.links()
                h.append("</ul>")
        h.append(f"</{tag}>")

    def story(self, short: bool = False) -> None:
        r, h = self.r, self.html
        junk = 0.5 if r.random() < 0.15 else 0.0
        tag = r.choice(["article", "article", "article", "main", "div", "div", "div", "section", "td", ""])
        names = self.name(TEXT_NAMES) if tag != "article" or r.random() < 0.5 else ""
        if tag in ("div", "section") and not names and r.random() < 0.8:
            names = f' class="{r.choice(TEXT_NAMES)}"'
        outer = r.random() < 0.3
        if outer:
            h.append(f"<{r.choice(['main', 'div'])}{self.name(TEXT_NAMES)}>")
        if tag == "td":
            h.append("<table><tr>")
            if r.random() < 0.5:
                h.append(f"<td{self.name(REST_NAMES['nav'])}>")
                for _ in range(r.randint(1, 4)):
                    self.put(r.choice(["p", "div"]), f'<a href="/x">{_sentence(r, 1, 3)}</a>', 0)
                h.append("</td>")
        h.append(f"<{tag}{names}>" if tag else "")
        nested = r.random() < 0.15
        if nested:
            h.append(f"<{r.choice(['div', 'section'])}{self.name(TEXT_NAMES)}>")
        if r.random() < (0.4 if short else 0.85):
            inner = r.random() < 0.2
            h.append("<header>" if inner else "")
            self.put(r.choice(["h1", "h1", "h2"]), _sentence(r, 2, 12, junk), 1)
            h.append("</header>" if inner else "")
        for _ in range(r.randint(1, 3 if short else 14)):
            x = r.random() * (0.8 if short else 1)
            if x < 0.64:
                text = _sentence(r, *r.choice([(1, 1), (1, 4), (5, 30), (30, 120)]), junk)
                if r.random() < 0.2:
                    text = f"<b>{text}<br>"
                elif r.random() < 0.2:
                    text += ' <a href="/y">' + _sentence(r, 1, 4) + "</a>"
                self.put(r.choice(["p", "p", "p", "p", "div"]), text, 1)
            elif x < 0.71:
                self.put(r.choice(["h2", "h3"]), _sentence(r, 1, 6, junk), 1)
            elif x < 0.77:
                kind = r.choice(["ul", "ol"])
                h.append(f"<{kind}>")
                for _ in range(r.randint(1, 4)):
                    self.put("li", _sentence(r, 2, 15, junk), 1)
                h.append(f"</{kind}>")
            elif x < 0.81:
                h.append("<blockquote>")
                self.put("p", _sentence(r, 5, 30, junk), 1)
                h.append("</blockquote>")
            elif x < 0.84:
                h.append("<table><tr>")
                self.put("td", _sentence(r, 1, 5), 1)
                self.put("td", _sentence(r, 1, 5), 1)
                h.append("</tr></table>")
            elif x < 0.86:
                h.append(_sentence(r, 5, 30, junk) + "<hr>")
                self.labels.append(1)
            elif x < 0.88:
                self.put("pre", _sentence(r, 3, 10), 1)
            else:
                self.rest(r.choice(["ad", "side", "share", "form", "notice"]))
        if r.random() < 0.2:
            self.rest("comments")
        if tag == "td" and r.random() < 0.4:
            h.append(f"</td><td{self.name(REST_NAMES['side'])}>")
            self.put("p", _sentence(r, 2, 15), 0)
        h.append({"td": "</td></tr></table>", "": ""}.get(tag, f"</{tag}>"))
        if outer:
            h.append("</div></main>")


def training_pages(n: int = PAGES, seed: int = 11) -> tuple[list[list[Block]], list[list[int]]]:
    """Pages of varied layouts as blocks, with labels: 1 for main text, 0 for the rest."""
    r = random.Random(seed)
    pages, tags = [], []
    for _ in range(n):
        w = _Writer(r)
        bare = r.random() < 0.08  # nothing but the story
        w.html.append("<!DOCTYPE html><html><head>")
        if not bare:
            w.put("title", _sentence(r, 2, 10), 0)
        w.html.append("</head><body>")
        before = [] if bare else [k for k in ("header", "nav", "notice", "ad", "form", "side") if r.random() < 0.5]
        r.shuffle(before)
        for kind in before:
            w.rest(kind)
        w.story(bare)
        after = [] if bare else [k for k in ("comments", "side", "ad", "share", "form", "notice", "nav") if r.random() < 0.35]
        r.shuffle(after)
        for kind in after:
            w.rest(kind)
        if not bare and r.random() < 0.8:
            w.rest("footer")
        got = blocks("".join(w.html) + "</body></html>")
        if len(got) == len(w.labels):  # else a random text was empty or met its neighbour
            pages.append(got)
            tags.append(w.labels)
    return pages, tags


def page_features(page: list[Block]) -> list[set[str]]:
    return [path_features(b.node) | text_features(b, i, len(page)) for i, b in enumerate(page)]


@cache
def trained(n: int = PAGES, seed: int = 11) -> ChainCRF:
    """The field trained on n labelled pages; kept for the process."""
    pages, tags = training_pages(n, seed)
    field = ChainCRF()
    field.fit([page_features(p) for p in pages], tags)
    return field


class _State:
    """What a chain of ancestors scores: shared by all pages, and continued by the elements inside of it."""

    __slots__ = ("known", "sums", "near", "total", "inner")

    def __init__(self, known: frozenset, sums: np.ndarray, near: np.ndarray, total: np.ndarray):
        self.known, self.sums, self.near, self.total, self.inner = known, sums, near, total, {}


class Extractor:
    """Decodes pages with one field.

    A chain of ancestors is scored from the chain around it, with the features that are new; so the work for a
    page is in proportion to its elements, however deep. States of chains are kept for other pages up to a bound.
    """

    def __init__(self, field: ChainCRF):
        self.field = field
        none = np.zeros(field.labels)
        self.root = _State(frozenset(), none, none, none)
        self.kept = 0
        self.texts: dict[frozenset, np.ndarray] = {}

    def _inside(self, around: _State, tag: str, names: str) -> _State:
        new = {f for f in element_features(tag, names) if f in self.field.index} - around.known
        known, sums = (around.known | new, around.sums + self.field.scores(new)) if new else (around.known, around.sums)
        near = self.field.scores({f"near:{p}" for p in name_parts(names)}) if names else around.near
        return _State(known, sums, near, sums + near + self.field.scores({f"parent:{tag}"}))

    def state(self, node: Node | None) -> _State:
        todo = []
        while node is not None and node.state is None:
            todo.append(node)
            node = node.around
        now = self.root if node is None else node.state
        for node in reversed(todo):
            key = (node.tag, node.names)
            inner = now.inner.get(key)
            if inner is None:
                inner = self._inside(now, *key)
                if self.kept < CACHE_PATHS:
                    self.kept += 1
                    now.inner[key] = inner
            node.state = now = inner
        return now

    def labels(self, page: list[Block]) -> list[int]:
        rows = []
        for i, b in enumerate(page):
            features = frozenset(text_features(b, i, len(page)))
            of_text = self.texts.get(features)
            if of_text is None:
                of_text = self.texts[features] = self.field.scores(features)
            rows.append(self.state(b.node).total + of_text)
        return self.field.decode(np.array(rows))

    def text(self, page: str | None) -> str:
        own = blocks(page)
        return "\n".join(b.text for b, y in zip(own, self.labels(own)) if y) if own else ""


def main_text(pages: DataFrame, field: ChainCRF | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` with text and n_chars (code points) of the main text of each whole html."""
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        extractor = Extractor(sent.value)
        for part in bounded(batches, 1000, 8_000_000, html_col):
            texts = [extractor.text(p) for p in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return spread(pages.select(*dict.fromkeys([*keep, html_col]))).mapInArrow(run, f"{fields}, text string, n_chars bigint")

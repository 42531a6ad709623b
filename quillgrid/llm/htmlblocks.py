"""Leaf blocks of HTML pages, with their ancestors, by one pass over the tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values from the HTML standard: elements without an end tag, and elements whose content is raw text that is not of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes".split())
#: Elements with a language of their own, where <x/> has no content; blocks but for titles end them.
FOREIGN = frozenset("svg math".split())
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose inside does not end what is open around them, but for parts of tables.
CELLS = ("td", "th", "table")
SPECIAL = FOREIGN.union(CELLS)
#: What the start of an element ends, if it is open above the nearest of the second group.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}

#: A section or instruction, or a tag with its name and attributes; an attribute's value may hold ">" in quotes.
_TAG = re.compile(r"""<(?:!\[CDATA\[|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?>[^"'>]|"[^"]*"|'[^']*'|["'])*+)>)""", re.S)
_PLAIN = re.compile(r"<(?:!\[CDATA\[|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
_OPENS = re.compile(r"<[/a-zA-Z!?]")
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}


class Node:
    """An open element, linked to the one around it, so that any number of blocks share their ancestors."""

    __slots__ = ("around", "tag", "names", "state")

    def __init__(self, around: Node | None, tag: str, names: str):
        self.around, self.tag, self.names, self.state = around, tag, names, None

    def path(self) -> list[tuple[str, str]]:
        """(element, class and id names) from the outside in."""
        out, node = [], self
        while node is not None:
            out.append((node.tag, node.names))
            node = node.around
        return out[::-1]


@dataclass
class Block:
    """A leaf block: its text, the innermost element around it (None: none), and its characters inside links."""

    text: str
    node: Node | None
    linked: int


class _Open:
    """The open elements, with the places of each name, so that nothing looks through all of them."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.special = 0  # open elements of FOREIGN and CELLS

    def last(self, *tags: str) -> int:
        """The innermost place of any of the elements, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first(self, *tags: str) -> int | None:
        return min((self.places[t][0] for t in tags if self.places.get(t)), default=None)

    def push(self, tag: str, names: str) -> None:
        at = len(self.nodes)
        self.nodes.append(Node(self.nodes[-1] if at else None, tag, names))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.block_places.append(at)
        if tag in SPECIAL:
            self.special += 1

    def close(self, at: int) -> None:
        """End the element at a place and all inside of it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()
            if tag in SPECIAL:
                self.special -= 1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text in page order; white space inside a block is one space.

    Ends of elements that are not open are ignored but for a block's end; open elements end with an
    ancestor that ends, and paragraphs with the start of a block. Raw text (RAW) is skipped up to its end tag,
    or the page's end without one, as browsers do; the text of all other elements is kept. A tag whose quotes
    never close ends at the next ">", and from there on quotes are ignored; without any ">" it is text.
    The time is in proportion to the page's length, however deep elements are nested.
    """
    out: list[Block] = []
    if not page:
        return out
    open_ = _Open()
    parts: list[str] = []
    linked = 0
    last = page.rfind(">")
    tag_at = _TAG.match

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, open_.nodes[-1] if open_.nodes else None, linked))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if open_.places.get("a"):
                linked += len(raw)

    at = 0
    while at < len(page):
        opens = _OPENS.search(page, at)
        start = opens.start() if opens else len(page)
        say(page[at:start])
        if not opens:
            break
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        if start > last:
            say(page[start:])
            break
        m = tag_at(page, start)
        if not m:
            if page[start + 1 : start + 2] == "/" and not page[start + 2 : start + 3].isalpha():
                say("<")
                at = start + 1
                continue
            tag_at = _PLAIN.match
            m = tag_at(page, start)
            if not m:
                say("<")
                at = start + 1
                continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            if parts:
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        foreign = open_.first(*FOREIGN) if open_.special else None
        block = tag in BLOCK and (foreign is None or tag != "title")
        if block:
            flush()
        if m[1]:
            own = open_.places.get(tag)
            if own and (not open_.special or tag in ("table", "tr", "tbody", "thead", "tfoot") or own[-1] >= open_.last(*CELLS)):
                open_.close(own[-1])
            continue
        if block:
            if foreign is not None:
                open_.close(foreign)
            if open_.block_places and open_.nodes[open_.block_places[-1]].tag == "p":
                open_.close(open_.block_places[-1])
            if tag in _ENDS:
                ended, within = _ENDS[tag]
                own = open_.last(*ended)
                if own > open_.last(*within):
                    open_.close(own)
        if tag not in VOID and not (m[3].endswith("/") and (tag in FOREIGN or foreign is not None and not block)):
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(m[3])) if "=" in m[3] else ""
            open_.push(tag, names)
    flush()
    return out


def name_parts(names: str) -> set[str]:
    """The lower-case words that class and id names are made of."""
    return {p.lower() for p in _PARTS.findall(names)}

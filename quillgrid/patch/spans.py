"""Byte spans of a worksheet's rows and cells, and the rewriting of the spans that change.

One pass of the parser notes where every row of interest starts and ends and where the cells to be changed
lie. The new part is the old bytes with those spans replaced, so all other bytes stay.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from ..errors import EngineError, UnsupportedError
from ..functions import refs
from ..sources.package import Stop, feed, main_name, parser


@dataclass
class Change:
    """What a cell becomes: style None keeps it; content None keeps it."""

    row: int
    col: int
    style: int | None = None
    content: tuple | None = None  # ("value", v) or ("formula", text)


@dataclass
class Span:
    start: int
    end: int  # behind the element
    row: int
    col: int = 0
    attrs: dict = field(default_factory=dict)
    inner: tuple[int, int] | None = None  # None for an empty element
    formula: dict | None = None


@dataclass
class Layout:
    rows: dict[int, Span]
    cells: dict[tuple[int, int], Span]
    data: Span
    dimension: tuple[int, int, str] | None
    prefix: str
    merged: list[refs.Area]
    groups: list[refs.Area]  # areas of shared, array and table formulas


def _tag_end(raw: bytes, at: int) -> int:
    """Behind the `>` of the tag that starts at `at`."""
    quote = 0
    for i in range(at, len(raw)):
        c = raw[i]
        if quote:
            if c == quote:
                quote = 0
        elif c in (0x22, 0x27):
            quote = c
        elif c == 0x3E:
            return i + 1
    raise EngineError("malformed worksheet")


def read(raw: bytes, wanted: set[tuple[int, int]]) -> Layout:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or b'encoding="UTF-16' in raw[:200] or b"encoding='UTF-16" in raw[:200]:
        raise UnsupportedError("only worksheets in UTF-8 are edited")
    rows: dict[int, Span] = {}
    cells: dict[tuple[int, int], Span] = {}
    wanted_rows = {r for r, _ in wanted}
    state: dict = {"row": 0, "col": 1, "data": None, "dimension": None, "prefix": "", "open": None}
    merged: list[refs.Area] = []
    groups: list[refs.Area] = []

    def start(name, attrs):
        local, at = main_name(name), p.CurrentByteIndex
        if local == "sheetData":
            end = _tag_end(raw, at)
            tag = raw[at + 1 : end].split()[0].strip(b"/>").decode()
            state["prefix"] = tag.rpartition(":")[0]
            state["data"] = Span(at, end, 0, inner=None if raw[end - 2 : end] == b"/>" else (end, end))
        elif local == "dimension":
            state["dimension"] = (at, _tag_end(raw, at), attrs.get("ref", ""))
        elif local == "row":
            state["row"] = int(attrs.get("r", state["row"] + 1))
            state["col"] = 1
            end = _tag_end(raw, at)
            rows[state["row"]] = Span(at, end, state["row"], attrs=attrs, inner=None if raw[end - 2 : end] == b"/>" else (end, end))
        elif local == "c":
            col = refs.cell(attrs["r"])[1] if "r" in attrs else state["col"]
            state["col"] = col + 1
            key = (state["row"], col)
            state["open"] = None
            if state["row"] in wanted_rows:
                end = _tag_end(raw, at)
                state["open"] = cells[key] = Span(at, end, *key, attrs=attrs, inner=None if raw[end - 2 : end] == b"/>" else (end, end))
        elif local == "f":
            if state["open"] is not None:
                state["open"].formula = dict(attrs)
            if attrs.get("t") in ("shared", "array", "dataTable") and attrs.get("ref"):
                groups.append(refs.area(attrs["ref"]))
        elif local == "mergeCell":
            merged.append(refs.area(attrs.get("ref", "")))

    def end(name):
        local, at = main_name(name), p.CurrentByteIndex
        span = state["data"] if local == "sheetData" else rows.get(state["row"]) if local == "row" else state["open"] if local == "c" else None
        if span is not None and span.inner is not None:
            span.inner, span.end = (span.inner[0], at), _tag_end(raw, at)

    p = parser(start, end)
    import io

    feed(p, io.BytesIO(raw))
    if state["data"] is None:
        raise EngineError("the worksheet has no sheetData")
    return Layout(rows, cells, state["data"], state["dimension"], state["prefix"], merged, groups)


def _attrs(attrs: dict) -> str:
    return "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in attrs.items())


def _spelt(raw: bytes, span: Span) -> dict[str, str]:
    """The attributes of an element as spelt, so that those of foreign namespaces keep their prefixes."""
    import html
    import re

    tag = raw[span.start : _tag_end(raw, span.start)].decode()
    return {k: html.unescape(a or b) for k, a, b in re.findall(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)}


def cell_xml(prefix: str, ref: str, attrs: dict, content: tuple | None) -> str:
    q = f"{prefix}:" if prefix else ""
    attrs = {k: v for k, v in attrs.items() if k not in ("r", "t")}
    kind, body = None, ""
    if content is not None:
        what, v = content
        if what == "formula":
            body = f"<{q}f>{escape(v[1:])}</{q}f>"
        elif isinstance(v, bool):
            kind, body = "b", f"<{q}v>{int(v)}</{q}v>"
        elif isinstance(v, (int, float)):
            body = f"<{q}v>{v!r}</{q}v>"
        elif v is not None:
            kind = "inlineStr"
            body = f'<{q}is><{q}t xml:space="preserve">{_escaped(v)}</{q}t></{q}is>'
    head = {"r": ref, **attrs, **({"t": kind} if kind else {})}
    return f"<{q}c{_attrs(head)}>{body}</{q}c>" if body else f"<{q}c{_attrs(head)}/>"


def _escaped(text: str) -> str:
    import re

    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return escape(text).replace("\r", "&#13;")


def rewrite(raw: bytes, layout: Layout, changes: list[Change]) -> tuple[bytes, str]:
    """The new part, and a digest of the bytes that stay."""
    edits: list[tuple[int, int, bytes]] = []
    q = f"{layout.prefix}:" if layout.prefix else ""
    by_row: dict[int, list[Change]] = {}
    for c in sorted(changes, key=lambda c: (c.row, c.col)):
        by_row.setdefault(c.row, []).append(c)
    new_rows: list[tuple[int, str]] = []
    for row, own in by_row.items():
        span = layout.rows.get(row)
        made = []
        for c in own:
            old = layout.cells.get((c.row, c.col))
            attrs = _spelt(raw, old) if old else {}
            if c.style is not None:
                attrs["s"] = str(c.style)
            ref = refs.name(c.row, c.col)
            if c.content is None and old is not None:
                head = raw[old.start : _tag_end(raw, old.start)]
                text = f"<{q}c{_attrs({'r': ref, **{k: v for k, v in attrs.items() if k != 'r'}})}{'/' if old.inner is None else ''}>"
                edits.append((old.start, old.start + len(head), text.encode()))
            elif old is not None:
                edits.append((old.start, old.end, cell_xml(layout.prefix, ref, attrs, c.content).encode()))
            else:
                made.append((c.col, cell_xml(layout.prefix, ref, attrs, c.content)))
        if span is None:
            new_rows.append((row, f'<{q}row r="{row}">{"".join(x for _, x in made)}</{q}row>'))
        elif made and span.inner is None:
            tag = raw[span.start : span.end]
            edits.append((span.start, span.end, tag[:-2].rstrip() + b">" + "".join(x for _, x in made).encode() + f"</{q}row>".encode()))
        else:
            there = sorted((col, s) for (r, col), s in layout.cells.items() if r == row)
            for col, text in made:
                after = next((s for k, s in there if k > col), None)
                at = after.start if after else span.inner[1]
                edits.append((at, at, text.encode()))
    if new_rows:
        known = sorted(layout.rows)
        if layout.data.inner is None:
            tag = raw[layout.data.start : layout.data.end]
            body = "".join(x for _, x in new_rows)
            edits.append((layout.data.start, layout.data.end, tag[:-2].rstrip() + b">" + body.encode() + f"</{q}sheetData>".encode()))
        else:
            for row, text in new_rows:
                after = next((r for r in known if r > row), None)
                at = layout.rows[after].start if after else layout.data.inner[1]
                edits.append((at, at, text.encode()))
    if layout.dimension and layout.dimension[2]:
        a = refs.area(layout.dimension[2])
        grown = refs.Area(min(a.top, *(c.row for c in changes)), min(a.left, *(c.col for c in changes)), max(a.bottom, *(c.row for c in changes)), max(a.right, *(c.col for c in changes)))
        if grown != a:
            start, end, _ = layout.dimension
            edits.append((start, end, raw[start:end].replace(layout.dimension[2].encode(), str(grown).encode())))
    out, kept, at = [], hashlib.sha256(), 0
    for start, end, text in sorted(edits, key=lambda e: (e[0], e[1])):
        if start < at:
            raise EngineError("edits overlap")
        out += [raw[at:start], text]
        kept.update(raw[at:start])
        at = end
    out.append(raw[at:])
    kept.update(raw[at:])
    return b"".join(out), kept.hexdigest()

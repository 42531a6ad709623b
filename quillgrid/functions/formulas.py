"""Formulas: relative form, translation and precedents, by a small tokenizer."""

from __future__ import annotations

import re

from . import refs

#: Functions whose operands depend on values, so that precedents cannot be complete.
INDIRECT = ("INDIRECT", "OFFSET")

_REF = r"\$?[A-Za-z]{1,3}\$?[1-9]\d{0,6}"
_TOKEN = re.compile(
    rf"""(?P<text>"(?:[^"]|"")*")
    |(?P<sheet>(?:'(?:[^']|'')*'|\[[^\]]*\][^\s!'"()+\-*/^&=<>,;:]*|[^\W\d][\w.]*(?::[^\W\d][\w.]*)?)!)?
     (?:(?P<area>{_REF}:{_REF})|(?P<cols>\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}})|(?P<rows>\$?[1-9]\d*:\$?[1-9]\d*)|(?P<cell>{_REF}))(?![\w.(!])
    |(?P<name>[^\W\d][\w.\\]*(?:\[[^\]]*(?:\[[^\]]*\][^\]]*)*\])?)(?P<call>\s*\()?
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
    |(?P<other>.)""",
    re.X | re.S,
)
_PART = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d{0,6})")


def _pieces(formula: str):
    at = 0
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        yield m
        at = m.end()


def _map_refs(formula: str, put) -> str:
    """The formula with put(match of a cell) in place of every cell reference outside of text."""
    out = []
    for m in _pieces(formula):
        ref = m["area"] or m["cell"]
        out.append((m["sheet"] or "") + _PART.sub(put, ref) if ref else m[0])
    return "".join(out)


def relative(formula: str, row: int, col: int) -> str:
    """The formula with references as distances from its cell: equal formulas of a run have equal forms."""

    def put(m):
        c = refs.column_number(m[2]) if m[1] else refs.column_number(m[2]) - col
        r = int(m[4]) if m[3] else int(m[4]) - row
        return ("R" + (str(r) if m[3] else f"[{r}]")) + ("C" + (str(c) if m[1] else f"[{c}]"))

    return _map_refs(formula, put)


def translate(formula: str, origin: tuple[int, int], target: tuple[int, int]) -> str:
    """The formula as copied from origin to target; a reference pushed off the sheet becomes #REF!."""
    down, right = target[0] - origin[0], target[1] - origin[1]

    def put(m):
        c = refs.column_number(m[2]) + (0 if m[1] else right)
        r = int(m[4]) + (0 if m[3] else down)
        if not (1 <= c <= refs.MAX_COL and 1 <= r <= refs.MAX_ROW):
            return "#REF!"
        return f"{m[1]}{refs.column_letters(c)}{m[3]}{r}"

    return _map_refs(formula, put)


def precedents(formula: str) -> tuple[list[str], bool]:
    """The ranges a formula names, each once in order, and whether that is all it reads."""
    found, complete = [], True
    for m in _pieces(formula):
        ref = m["area"] or m["cell"] or m["cols"] or m["rows"]
        if ref:
            ref = (m["sheet"] or "") + ref
            if ref not in found:
                found.append(ref)
        elif m["name"]:
            if m["call"]:
                complete &= m["name"].upper() not in INDIRECT
            elif m["name"].upper() not in ("TRUE", "FALSE"):  # defined names and table columns are ranges too
                if m["name"] not in found:
                    found.append(m["name"])
    return found, complete

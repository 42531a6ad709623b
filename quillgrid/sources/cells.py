"""Streaming scan of a worksheet's cells, and their typed and textual forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

from ..errors import EngineError, UnsupportedError
from ..functions import refs
from .package import CHUNK, main_name, parser, unescaped


@dataclass(slots=True)
class Cell:
    row: int
    col: int
    kind: str  # as written: n, s, b, e, str, inlineStr, ...
    raw: str | None  # the text of v, or of the inline string
    style: int
    formula: str | None
    f_type: str | None
    f_ref: str | None
    f_si: str | None

    @property
    def ref(self) -> str:
        return refs.name(self.row, self.col)


def scan(stream, area: refs.Area | None = None, columns: set[int] | None = None) -> Iterator[Cell]:
    """The cells of an area in row order; decoding starts and ends with its rows.

    Rows must rise, a cell must lie in its row and occur once; elements of foreign namespaces and
    phonetic runs are passed over.
    """
    ready: list[Cell] = []
    row = last_row = 0
    wanted = skip = done = False
    seen: set[int] = set()
    col = 0
    attrs_of: dict = {}
    value: list[str] | None = None
    inline: list[str] | None = None
    formula: list[str] | None = None
    f_attrs: dict | None = None
    into: list[str] | None = None
    phonetic = 0
    foreign = 0
    next_col = 1

    def start(name, attrs):
        nonlocal row, last_row, wanted, skip, done, col, attrs_of, value, inline, formula, f_attrs, into, phonetic, foreign, next_col
        local = main_name(name)
        if local is None or foreign:
            foreign += 1
            return
        if local == "row":
            row = int(attrs["r"]) if "r" in attrs else last_row + 1
            if row <= last_row:
                raise EngineError(f"row {row} does not follow row {last_row}")
            if row > refs.MAX_ROW:
                raise EngineError(f"row {row} is outside of the sheet")
            last_row = row
            seen.clear()
            next_col = 1
            skip = area is not None and row < area.top
            done = area is not None and row > area.bottom
        elif local == "c":
            if "r" in attrs:
                r, col = refs.cell(attrs["r"])
                if r != row:
                    raise EngineError(f"cell {attrs['r']} lies in row {row}")
            else:
                col = next_col
            next_col = col + 1
            wanted = not (skip or done) and (area is None or area.left <= col <= area.right) and (columns is None or col in columns)
            if wanted:
                if col in seen:
                    raise EngineError(f"duplicate cell {refs.name(row, col)}")
                seen.add(col)
            attrs_of, value, inline, formula, f_attrs = attrs, None, None, None, None
        elif wanted:
            if local == "v":
                into = value = []
            elif local == "f":
                into = formula = []
                f_attrs = attrs
            elif local == "is":
                inline = []
            elif local == "rPh":
                phonetic += 1
            elif local == "t" and inline is not None and not phonetic:
                into = inline

    def end(name):
        nonlocal wanted, into, phonetic, foreign
        if foreign:
            foreign -= 1
            return
        local = main_name(name)
        if local in ("v", "f", "t"):
            into = None
        elif local == "rPh" and wanted:
            phonetic -= 1
        elif local == "c" and wanted:
            kind = attrs_of.get("t", "n")
            raw = "".join(inline) if kind == "inlineStr" and inline is not None else "".join(value) if value is not None else None
            f = f_attrs or {}
            ready.append(Cell(row, col, kind, raw, int(attrs_of.get("s", 0)), "".join(formula) if formula is not None else None, f.get("t"), f.get("ref"), f.get("si")))
            wanted = False

    def say(data):
        if into is not None and not foreign:
            into.append(data)

    p = parser(start, end, say)
    try:
        while not done:
            chunk = stream.read(CHUNK)
            p.Parse(chunk, not chunk)
            yield from ready
            ready.clear()
            if not chunk:
                break
    except expat.ExpatError as e:
        raise EngineError(f"malformed worksheet: {e}") from e


def text_of(cell: Cell, strings: Callable[[int], str]) -> str | None:
    """The cell's text with numbers exactly as written; null without a value."""
    if cell.raw is None:
        return None
    if cell.kind == "s":
        return strings(_index(cell))
    if cell.kind == "b":
        return "True" if cell.raw.strip() == "1" else "False"
    if cell.kind in ("inlineStr", "str"):
        return unescaped(cell.raw)
    return cell.raw


def _index(cell: Cell) -> int:
    try:
        return int(cell.raw or "")
    except ValueError:
        raise EngineError(f"{cell.ref}: not a shared string index") from None


def value_of(cell: Cell, strings: Callable[[int], str]):
    """The cell's value as Python has it."""
    if cell.raw is None:
        return None
    if cell.kind == "n":
        raw = cell.raw.strip()
        try:
            return float(raw) if any(c in raw for c in ".eE") else int(raw)
        except ValueError:
            raise EngineError(f"{cell.ref}: not a number") from None
    if cell.kind == "b":
        return cell.raw.strip() == "1"
    return text_of(cell, strings)


def projected(cell: Cell, strings: Callable[[int], str], cached_formulas: bool) -> str | None:
    """text_of a cell in a typed projection, where errors and unwanted formulas are refused."""
    if cell.formula is not None or cell.f_type:
        if not cached_formulas:
            raise UnsupportedError(f"{cell.ref} holds a formula; cached values were not asked for")
        if not cell.raw:
            raise UnsupportedError(f"{cell.ref} holds a formula without a cached value")
    if cell.kind == "e":
        raise UnsupportedError(f"{cell.ref} holds the error {cell.raw}")
    return text_of(cell, strings)


def lookup(strings: list[str]) -> Callable[[int], str]:
    def get(i: int) -> str:
        if not 0 <= i < len(strings):
            raise EngineError(f"no shared string {i}")
        return strings[i]

    return get

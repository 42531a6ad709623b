"""Cell references: A1 text to numbers and back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

MAX_ROW, MAX_COL = 1_048_576, 16_384

_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9]\d{0,6})")


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as B7 or $B$7."""
    m = _CELL.fullmatch(ref.strip()) if isinstance(ref, str) else None
    if not m:
        raise EngineError(f"not a cell reference: {ref!r}")
    row, col = int(m[2]), column_number(m[1])
    if row > MAX_ROW or col > MAX_COL:
        raise EngineError(f"outside of the sheet: {ref!r}")
    return row, col


def name(row: int, col: int) -> str:
    return f"{column_letters(col)}{row}"


def plain(ref: Column) -> Column:
    """name(*cell(ref)) of a column of references; one that is none, null too, raises."""
    part = lambda i: F.regexp_extract(ref, r"^\s*\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})\s*$", i)
    letters, row = F.upper(part(1)), part(2)
    inside = (F.length(letters) < 3) | (letters <= column_letters(MAX_COL))
    refused = F.raise_error(F.concat(F.lit("quillgrid.errors.EngineError: not a cell reference: "), F.coalesce(ref, F.lit("null"))))
    return F.when((letters != "") & inside & (row.try_cast("int") <= MAX_ROW), F.concat(letters, row)).otherwise(refused)


@dataclass(frozen=True)
class Area:
    """A rectangle of cells, both ends included."""

    top: int
    left: int
    bottom: int
    right: int

    @property
    def rows(self) -> int:
        return self.bottom - self.top + 1

    @property
    def columns(self) -> int:
        return self.right - self.left + 1

    @property
    def cells(self) -> int:
        return self.rows * self.columns

    def __contains__(self, at: tuple[int, int]) -> bool:
        return self.top <= at[0] <= self.bottom and self.left <= at[1] <= self.right

    def __str__(self) -> str:
        a, b = name(self.top, self.left), name(self.bottom, self.right)
        return a if a == b else f"{a}:{b}"


def area(ref: str) -> Area:
    """The rectangle of A1:C9 or of one cell; reversed ends are an error."""
    first, _, last = str(ref).partition(":")
    top, left = cell(first)
    bottom, right = cell(last) if last else (top, left)
    if bottom < top or right < left:
        raise EngineError(f"the ends of {ref!r} are reversed")
    return Area(top, left, bottom, right)

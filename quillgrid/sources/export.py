"""Sinks of new workbooks: DataFrames as sheets.

`write_workbook` is for small results: the driver writes one sheet a DataFrame, row by row; sizes beyond a
sheet's, or beyond `most` rows, are refused. `write_parts` has no bound: the executors write the sheets, as
many as the rows need, and the driver only joins the compressed parts.
"""

from __future__ import annotations

import datetime
import decimal
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..errors import BudgetError
from ..functions import refs
from .package import MAIN, PACKAGE_RELATIONS, RELATION_IDS

MOST = 100_000
#: Fixed value: characters of a sheet's name.
NAME_CHARS = 31
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_HEAD = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[0]}"><sheetData>'.encode()
_TAIL = b"</sheetData></worksheet>"


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, decimal.Decimal)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
    text = v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _row(r: int, values) -> str:
    return f'<row r="{r}">{"".join(_cell(refs.name(r, c), v) for c, v in enumerate(values, 1))}</row>'


def _finish(z: zipfile.ZipFile, names: list[str]) -> None:
    """The parts that list the sheets."""
    rel = RELATION_IDS[0]
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in enumerate(names, 1))
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[0]}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE_RELATIONS}">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
    z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE_RELATIONS}"><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
    z.writestr("[Content_Types].xml", f'<Types xmlns="{_TYPES}"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}"/>' for i in range(1, len(names) + 1)) + "</Types>")


def write_workbook(path: str, sheets: dict[str, DataFrame], most: int = MOST) -> dict[str, str]:
    """Write the sheets with header rows; returns the range of each. Dates and times are written as text."""
    ranges: dict[str, str] = {}
    part = f"{path}.part"
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for i, (name, rows) in enumerate(sheets.items(), 1):
                n = 1
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                    f.write(_HEAD)
                    f.write(_row(1, rows.columns).encode())
                    for row in rows.toLocalIterator():
                        n += 1
                        if n > min(most + 1, refs.MAX_ROW):
                            raise BudgetError(f"sheet {name!r} has more than {min(most, refs.MAX_ROW - 1)} rows")
                        f.write(_row(n, row).encode())
                    f.write(_TAIL)
                ranges[name] = str(refs.Area(1, 1, n, len(rows.columns)))
            _finish(z, list(sheets))
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return ranges


class _Part:
    """The XML of one sheet with a header row, deflated into a file of its own as an archive holds it."""

    def __init__(self, folder: str, names: list[str]):
        self.path = os.path.join(folder, uuid.uuid4().hex)
        self.file, self.packer = open(self.path, "wb"), zlib.compressobj(wbits=-zlib.MAX_WBITS)
        self.crc = self.size = self.packed = self.rows = 0
        self._put(_HEAD)
        self.add([names])

    def _put(self, data: bytes, end: bool = False) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self.packed += self.file.write(self.packer.compress(data) + (self.packer.flush() if end else b""))

    def add(self, rows: list) -> None:
        self._put("".join(_row(r, values) for r, values in enumerate(rows, self.rows + 1)).encode())
        self.rows += len(rows)

    def close(self) -> tuple:
        """(path, rows with the header row, crc, size, compressed size)"""
        self._put(_TAIL, True)
        self.file.close()
        return self.path, self.rows, self.crc, self.size, self.packed


_PARTS = "sheet long, task long, piece long, path string, rows long, crc long, size long, packed long"


def _writer(k: int, names: list[str], most: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows of the k-th DataFrame it makes the parts, and returns what they are."""

    def told(piece: int, part: _Part) -> pa.RecordBatch:
        values = [k, TaskContext.get().partitionId(), piece, *part.close()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _PARTS.split(", ")])

    def write(batches):
        piece, part = 0, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            while rows:
                if part is not None and part.rows > most:
                    yield told(piece, part)
                    piece, part = piece + 1, None
                part = part or _Part(folder, names)
                room = most + 1 - part.rows
                part.add(rows[:room])
                rows = rows[room:]
        if part is not None:
            yield told(piece, part)

    return write


def _append(z: zipfile.ZipFile, name: str, path: str, crc: int, size: int, packed: int) -> None:
    """A file of deflated bytes as the next member; the bytes stay as they are."""
    info = zipfile.ZipInfo(name)
    info.compress_type, info.CRC, info.file_size, info.compress_size, info.header_offset = zipfile.ZIP_DEFLATED, crc, size, packed, z.fp.tell()
    z.fp.write(info.FileHeader())
    with open(path, "rb") as f:
        shutil.copyfileobj(f, z.fp, 1 << 20)
    z.filelist.append(info)
    z.NameToInfo[name] = info
    z.start_dir = z.fp.tell()


def write_parts(path: str, sheets: dict[str, DataFrame], most: int | None = None) -> dict[str, dict[str, str]]:
    """Write DataFrames of any size by one job, each on as many sheets with header rows as it needs.

    Every task that has rows begins a sheet, and goes on with another one after `most` rows (as many as a sheet
    holds, if not given). The first sheet has the DataFrame's name, others the name with a number; the sheets
    follow the order of the rows. Returns the sheets of each name with their ranges. The path must lie in a
    folder that the driver and all executors share.
    """
    most = refs.MAX_ROW - 1 if most is None else min(most, refs.MAX_ROW - 1)
    if most < 1:
        raise BudgetError("a sheet needs room for a row")
    folder = tempfile.mkdtemp(prefix=".parts-", dir=os.path.dirname(os.path.abspath(path)))
    whole = os.path.join(folder, "book")
    try:
        made = [rows.mapInArrow(_writer(k, rows.columns, most, folder), _PARTS) for k, rows in enumerate(sheets.values())]
        parts: list[list[tuple]] = [[] for _ in made]
        for p in sorted(functools.reduce(DataFrame.union, made).collect(), key=lambda p: (p.sheet, p.task, p.piece)) if made else []:
            parts[p.sheet].append((p.path, p.rows, p.crc, p.size, p.packed))
        ranges: dict[str, dict[str, str]] = {}
        taken, listed = {name.casefold() for name in sheets}, []
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
            for (name, rows), own in zip(sheets.items(), parts):
                ranges[name], n = {}, 1
                for sheet_path, bottom, *sizes in own or [_Part(folder, rows.columns).close()]:
                    sheet = name
                    while ranges[name] and sheet.casefold() in taken:
                        n += 1
                        sheet = name[: NAME_CHARS - len(f" ({n})")] + f" ({n})"
                    taken.add(sheet.casefold())
                    listed.append(sheet)
                    ranges[name][sheet] = str(refs.Area(1, 1, bottom, len(rows.columns)))
                    _append(z, f"xl/worksheets/sheet{len(listed)}.xml", sheet_path, *sizes)
            _finish(z, listed)
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return ranges

"""Workbook packages: parts, sheets, tables, names and shared strings, without a scan of cells."""

from __future__ import annotations

import os
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.parsers import expat

from ..errors import EngineError, UnsupportedError
from ..functions import refs

#: Namespaces of the two dialects of the file format.
MAIN = ("http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://purl.oclc.org/ooxml/spreadsheetml/main")
RELATION_IDS = ("http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://purl.oclc.org/ooxml/officeDocument/relationships")
PACKAGE_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
CHUNK = 1 << 17


def main_name(full: str) -> str | None:
    """The local name of an element of the main namespaces; None for foreign ones."""
    space, _, local = full.rpartition(" ")
    return local if space in MAIN else None


def parser(start=None, end=None, text=None):
    """An expat parser with namespaces that refuses document types."""
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True

    def refuse(*_):
        raise UnsupportedError("document types are refused")

    p.StartDoctypeDeclHandler = refuse
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    return p


class Stop(Exception):
    """Raised by a handler that has seen enough."""


def feed(p, stream) -> None:
    try:
        while chunk := stream.read(CHUNK):
            p.Parse(chunk, False)
        p.Parse(b"", True)
    except Stop:
        pass
    except expat.ExpatError as e:
        raise EngineError(f"malformed XML: {e}") from e


@dataclass
class Table:
    name: str
    sheet: str
    area: refs.Area
    headers: int
    totals: int
    columns: list[str]
    part: str


@dataclass
class Sheet:
    name: str
    part: str
    state: str = "visible"
    dimension: str | None = None
    freeze: str | None = None
    tables: list[str] = field(default_factory=list)


class Package:
    """An .xlsx or .xlsm file. Opening reads the directory of the archive and the metadata parts only."""

    def __init__(self, path: str | os.PathLike):
        self.path = os.fspath(path)
        if not self.path.lower().endswith((".xlsx", ".xlsm")):
            raise UnsupportedError("only .xlsx and .xlsm files are read")
        try:
            self.stamp = self._stamp()
            self.archive = zipfile.ZipFile(self.path)
        except (OSError, zipfile.BadZipFile) as e:
            raise EngineError(f"cannot open {self.path}: {e}") from e
        self.parts: dict[str, zipfile.ZipInfo] = {}
        for info in self.archive.infolist():
            if info.filename in self.parts:
                raise EngineError(f"duplicate member {info.filename!r}")
            if info.flag_bits & 1:
                raise UnsupportedError("encrypted members are not read")
            self.parts[info.filename] = info
        self.sheets: dict[str, Sheet] = {}
        self.tables: dict[str, Table] = {}
        self.names: list[dict] = []
        self.calculation: dict = {}
        self._read_workbook()

    def _stamp(self) -> tuple:
        s = os.stat(self.path)
        return s.st_size, s.st_mtime_ns, s.st_ctime_ns

    def check_unchanged(self) -> None:
        if self._stamp() != self.stamp:
            raise EngineError(f"{self.path} has changed since it was opened")

    def close(self) -> None:
        self.archive.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def open_part(self, part: str):
        if part not in self.parts:
            raise EngineError(f"the package has no part {part!r}")
        return self.archive.open(part)

    def read(self, part: str) -> bytes:
        with self.open_part(part) as f:
            return f.read()

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Of each relationship id: type, target part (or address) and whether it is external."""
        folder, base = posixpath.split(part)
        own = posixpath.join(folder, "_rels", f"{base}.rels")
        out: dict[str, tuple[str, str, bool]] = {}
        if own not in self.parts:
            return out

        def start(name, attrs):
            if name != f"{PACKAGE_RELATIONS} Relationship":
                return
            target, external = attrs.get("Target", ""), attrs.get("TargetMode") == "External"
            if not external:
                target = unquote(target)
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                if target.startswith("../") or target == "..":
                    raise EngineError(f"relationship of {part} leaves the package")
            out[attrs.get("Id", "")] = (attrs.get("Type", ""), target, external)

        with self.open_part(own) as f:
            feed(parser(start), f)
        return out

    def _read_workbook(self) -> None:
        root = next((t for kind, t, _ in self.relations("").values() if kind.endswith("/officeDocument")), "xl/workbook.xml")
        if root not in self.parts:
            raise EngineError("the package has no workbook")
        self.workbook_part = root
        related = self.relations(root)
        listed: list[tuple[str, str, str]] = []
        text: list[str] | None = None

        def start(name, attrs):
            nonlocal text
            local = main_name(name)
            if local == "sheet":
                rid = next((attrs[f"{s} id"] for s in RELATION_IDS if f"{s} id" in attrs), "")
                listed.append((attrs.get("name", ""), rid, attrs.get("state", "visible")))
            elif local == "definedName":
                self.names.append(dict(attrs))
                text = []
            elif local == "calcPr":
                self.calculation = dict(attrs)

        def end(name):
            nonlocal text
            if main_name(name) == "definedName" and text is not None:
                self.names[-1]["formula"] = "".join(text)
                text = None

        def say(data):
            if text is not None:
                text.append(data)

        with self.open_part(root) as f:
            feed(parser(start, end, say), f)
        for name, rid, state in listed:
            kind, part, external = related.get(rid, ("", "", False))
            if kind.endswith("/worksheet"):
                if external or part not in self.parts:
                    raise EngineError(f"sheet {name!r} has no part")
                self.sheets[name] = Sheet(name, part, state)
        self.strings_part = next((t for k, t, _ in related.values() if k.endswith("/sharedStrings")), None)
        self.styles_part = next((t for k, t, _ in related.values() if k.endswith("/styles")), None)
        for sheet in self.sheets.values():
            self._read_head(sheet)
            for kind, target, _ in self.relations(sheet.part).values():
                if kind.endswith("/table"):
                    self._read_table(sheet, target)

    def _read_head(self, sheet: Sheet) -> None:
        def start(name, attrs):
            local = main_name(name)
            if local == "dimension":
                sheet.dimension = attrs.get("ref")
            elif local == "pane" and attrs.get("state", "").startswith("frozen"):
                sheet.freeze = attrs.get("topLeftCell")
            elif local == "sheetData":
                raise Stop

        with self.open_part(sheet.part) as f:
            feed(parser(start), f)

    def _read_table(self, sheet: Sheet, part: str) -> None:
        got: dict = {}
        columns: list[str] = []

        def start(name, attrs):
            local = main_name(name)
            if local == "table":
                got.update(attrs)
            elif local == "tableColumn":
                columns.append(attrs.get("name", ""))

        with self.open_part(part) as f:
            feed(parser(start), f)
        table = Table(got.get("displayName") or got.get("name", ""), sheet.name, refs.area(got.get("ref", "")), int(got.get("headerRowCount", 1)), int(got.get("totalsRowCount", 0)), columns, part)
        if table.name.casefold() in {t.casefold() for t in self.tables}:
            raise EngineError(f"duplicate table {table.name!r}")
        self.tables[table.name] = table
        sheet.tables.append(table.name)

    def sheet(self, name: str) -> Sheet:
        try:
            return self.sheets[name]
        except KeyError:
            raise EngineError(f"unknown sheet {name!r}") from None

    def signature(self, *parts: str | None) -> list:
        """Checksums and sizes of parts, by which derived data are kept."""
        return [[p, self.parts[p].CRC, self.parts[p].file_size] for p in parts if p]

    def features(self) -> dict[str, bool]:
        has = lambda *marks: any(m in p for p in self.parts for m in marks)
        return {"macros": has("vbaProject.bin"), "charts": has("/charts/"), "pivots": has("/pivotTables/", "/pivotCache/"), "drawings": has("/drawings/"), "external_links": has("/externalLinks/"), "comments": has("/comments", "threadedComments"), "signatures": has("_xmlsignatures/"), "custom_xml": has("customXml/")}


def shared_strings(stream) -> list[str]:
    """The plain text of every shared string; phonetic runs are left out."""
    out: list[str] = []
    parts: list[str] = []
    inside = phonetic = False

    def start(name, attrs):
        nonlocal inside, phonetic
        local = main_name(name)
        if local == "si":
            parts.clear()
        elif local == "rPh":
            phonetic = True
        elif local == "t":
            inside = not phonetic

    def end(name):
        nonlocal inside, phonetic
        local = main_name(name)
        if local == "si":
            out.append(unescaped("".join(parts)))
        elif local == "rPh":
            phonetic = False
        elif local == "t":
            inside = False

    def say(data):
        if inside:
            parts.append(data)

    feed(parser(start, end, say), stream)
    return out


_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")


def unescaped(text: str) -> str:
    """Characters that the file format writes as _xHHHH_."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text

"""Patches: lists of cell operations, their checks, the edited workbook and its audit."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tempfile
from pathlib import Path

from ..errors import EngineError, UnsupportedError
from ..functions import formulas, refs
from ..sources import layout as styling
from ..sources.cells import scan, value_of
from ..sources.package import Package
from . import archive, spans

MOST = 10_000
CONTENT = ("SET_VALUE", "SET_FORMULA", "COPY_FORMULA")
STYLE = ("SET_STYLE", "COPY_STYLE")
#: The fields of patch files. Copies may name another sheet by source_sheet.
FIELDS = {"SET_VALUE": {"value"}, "SET_FORMULA": {"formula"}, "COPY_FORMULA": {"source_cell"}, "SET_STYLE": {"style_id"}, "COPY_STYLE": {"source_cell"}}


def _check_value(v) -> None:
    if not (v is None or isinstance(v, (bool, int, float, str))):
        raise EngineError("a value is null, truth, a number or a text")
    if isinstance(v, float) and not math.isfinite(v):
        raise EngineError("a number must be finite")
    if isinstance(v, str) and len(v.encode("utf-16-le", "surrogatepass")) // 2 > 32_767:
        raise EngineError("a text has at most 32767 characters")


def _check_formula(f) -> None:
    if not isinstance(f, str) or not f.startswith("=") or not 2 <= len(f) <= 8192:
        raise EngineError("a formula starts with = and has 2 to 8192 characters")


def parse(package: Package, operations) -> list[dict]:
    """Checked operations with the places of their cells."""
    if not isinstance(operations, list) or not 1 <= len(operations) <= MOST:
        raise EngineError(f"a patch has 1 to {MOST} operations")
    out, taken = [], set()
    for op in operations:
        kind = op.get("operation") if isinstance(op, dict) else None
        if kind not in FIELDS:
            raise EngineError(f"unknown operation {kind!r}")
        more = {"source_sheet"} if "source_cell" in FIELDS[kind] else set()
        if set(op) - FIELDS[kind] - more - {"operation", "sheet", "cell", "expected", "expected_formula"} or not FIELDS[kind] <= set(op):
            raise EngineError(f"{kind} has other fields than it needs")
        package.sheet(op.get("sheet"))
        at = refs.cell(op.get("cell"))
        slot = (op["sheet"], at, kind in CONTENT)
        if slot in taken:
            raise EngineError(f"two operations for the {'content' if kind in CONTENT else 'style'} of {op['cell']}")
        taken.add(slot)
        if kind == "SET_VALUE":
            _check_value(op["value"])
        elif kind == "SET_FORMULA":
            _check_formula(op["formula"])
        elif kind == "SET_STYLE" and (not isinstance(op["style_id"], int) or isinstance(op["style_id"], bool)):
            raise EngineError("a style is a number")
        source = None
        if "source_cell" in op:
            source = package.sheet(op.get("source_sheet", op["sheet"])).name, refs.cell(op["source_cell"])
        out.append(op | {"at": at, "source_at": source})
    return out


def _guard(package: Package, sheet: str, at: tuple[int, int], found: spans.Layout, content: bool) -> None:
    ref = refs.name(*at)
    for area in found.merged:
        if at in area and at != (area.top, area.left):
            raise UnsupportedError(f"{ref} lies inside of a merged range")
    if not content:
        return
    cell = found.cells.get(at)
    if cell is not None and (cell.formula or {}).get("t") in ("shared", "array", "dataTable") or any(at in g for g in found.groups):
        raise UnsupportedError(f"{ref} belongs to a formula group")
    if cell is not None and any(k in cell.attrs for k in ("cm", "vm")):
        raise UnsupportedError(f"{ref} has cell metadata")
    for t in package.tables.values():
        if t.sheet == sheet and at in t.area and (at[0] < t.area.top + t.headers or at[0] > t.area.bottom - t.totals):
            raise UnsupportedError(f"{ref} lies in the header or totals of table {t.name!r}")


def _recalculating(raw: bytes) -> bytes:
    """The workbook part, told to calculate everything when it is opened."""
    text = raw.decode("utf-8")
    m = re.search(r"<((?:\w+:)?)calcPr\b([^>]*?)(/?)>", text)
    if m:
        attrs = re.sub(r"\s+(?:fullCalcOnLoad|forceFullCalc)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", m[2])
        return (text[: m.start()] + f'<{m[1]}calcPr{attrs} fullCalcOnLoad="1" forceFullCalc="1"{m[3]}>' + text[m.end() :]).encode()
    prefix = re.search(r"<((?:\w+:)?)workbook\b", text)[1]
    at = max(text.rfind(f"</{prefix}{t}>") + len(f"</{prefix}{t}>") for t in ("sheets", "definedNames") if f"</{prefix}{t}>" in text)
    return (text[:at] + f'<{prefix}calcPr fullCalcOnLoad="1" forceFullCalc="1"/>' + text[at:]).encode()


def _without_chain(package: Package) -> tuple[dict[str, bytes], set[str]]:
    """Parts without the calculation chain, its relationship and its content type."""
    chain = next((t for k, t, _ in package.relations(package.workbook_part).values() if k.endswith("/calcChain")), None)
    if chain is None or chain not in package.parts:
        return {}, set()
    folder, base = os.path.split(package.workbook_part)
    own = f"{folder}/_rels/{base}.rels"
    related = re.sub(rb"<(?:\w+:)?Relationship\b[^>]*?/calcChain[\"'][^>]*?/>", b"", package.read(own))
    types = re.sub(rb"<(?:\w+:)?Override\b[^>]*?PartName=[\"']/" + re.escape(chain.encode()) + rb"[\"'][^>]*?/>", b"", package.read("[Content_Types].xml"))
    return {own: related, "[Content_Types].xml": types}, {chain}


def apply_patch(book, operations: list[dict], output, overwrite: bool = False) -> dict:
    """Write the edited workbook and, beside it, the audit; the source stays as it is."""
    package: Package = book.package
    package.check_unchanged()
    target = Path(output).resolve()
    source = Path(package.path).resolve()
    if target == source or target.exists() and os.path.samefile(target, source):
        raise EngineError("the output must be another file")
    if target.suffix.lower() != source.suffix.lower():
        raise EngineError("the output needs the extension of the source")
    audit = target.with_name(target.name + ".audit.json")
    if not overwrite and (target.exists() or audit.exists()):
        raise EngineError(f"{target} or its audit exists already")
    if package.features()["signatures"]:
        raise UnsupportedError("signed packages are not edited")
    ops = parse(package, operations)
    n_styles = styling.style_count(package.read(package.styles_part)) if package.styles_part else 1
    replaced: dict[str, bytes] = {}
    log: list[dict] = []
    certificates: dict[str, str] = {}
    recalculate = False
    expected: dict[str, dict] = {}
    sources: dict[tuple, dict] = {}
    for sheet in {op["source_at"][0] for op in ops if op["source_at"]}:
        wanted = {op["source_at"][1] for op in ops if op["source_at"] and op["source_at"][0] == sheet}
        sources |= {(sheet, at): cell for at, cell in _cells(book, sheet, wanted).items()}
    for sheet in dict.fromkeys(op["sheet"] for op in ops):
        own = [op for op in ops if op["sheet"] == sheet]
        ask = {op["at"] for op in own}
        before = _cells(book, sheet, ask)
        part = package.sheet(sheet).part
        raw = package.read(part)
        found = spans.read(raw, ask)
        changes: dict[tuple[int, int], spans.Change] = {}
        for op in own:
            at, kind = op["at"], op["operation"]
            _guard(package, sheet, at, found, kind in CONTENT)
            old = before[at]
            if "expected" in op and (old["value"] != op["expected"] or isinstance(old["value"], bool) != isinstance(op["expected"], bool)):
                raise EngineError(f"{op['cell']} holds {old['value']!r}, not {op['expected']!r}")
            if "expected_formula" in op and old["formula"] != op["expected_formula"]:
                raise EngineError(f"{op['cell']} holds the formula {old['formula']!r}, not {op['expected_formula']!r}")
            c = changes.setdefault(at, spans.Change(*at))
            if kind == "SET_VALUE":
                c.content = ("value", op["value"])
            elif kind == "SET_FORMULA":
                c.content = ("formula", op["formula"])
            elif kind == "COPY_FORMULA":
                from_cell = sources[op["source_at"]]
                if not from_cell["formula"] or from_cell["group"]:
                    raise UnsupportedError(f"{op['source_cell']} holds no formula of its own")
                c.content = ("formula", "=" + formulas.translate(from_cell["formula"][1:], op["source_at"][1], at))
            else:
                style = op["style_id"] if kind == "SET_STYLE" else sources[op["source_at"]]["style"]
                if not 0 <= style < n_styles:
                    raise EngineError(f"no style {style}")
                c.style = style
            recalculate |= kind in CONTENT
        replaced[part], certificates[part] = spans.rewrite(raw, found, list(changes.values()))
        for at, c in changes.items():
            old = before[at]
            new = {"value": old["value"], "formula": old["formula"], "style": old["style"] if c.style is None else c.style}
            if c.content is not None:
                new |= {"value": c.content[1], "formula": None} if c.content[0] == "value" else {"value": None, "formula": c.content[1]}
            expected.setdefault(sheet, {})[at] = new
            log.append({"sheet": sheet, "cell": refs.name(*at), "before": {k: old[k] for k in ("value", "formula", "style")}, "after": new})
    dropped: set[str] = set()
    if recalculate:
        more, dropped = _without_chain(package)
        replaced |= more
        replaced[package.workbook_part] = _recalculating(package.read(package.workbook_part))
    handle, part_file = tempfile.mkstemp(prefix=f".{target.stem}.", suffix=target.suffix, dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            records = archive.copy(package.path, f, replaced, dropped)
            f.flush()
            os.fsync(f.fileno())
        _verify(book, part_file, replaced, dropped, expected)
        package.check_unchanged()
        report = {"source": str(source), "output": str(target), "operations": len(ops), "changed_cells": len(log), "changed_parts": sorted(replaced), "removed_parts": sorted(dropped), "recalculation_requested": recalculate, "validated": True}
        whole = report | {"changes": log, "certificates": certificates, "compressed_records": records, "source_sha256": _digest(source), "output_sha256": _digest(part_file)}
        made, audit_file = tempfile.mkstemp(prefix=f".{audit.name}.", dir=target.parent)
        try:
            with os.fdopen(made, "w", encoding="utf-8") as f:
                json.dump(whole, f, ensure_ascii=False, indent=1)
            if not overwrite and (target.exists() or audit.exists()):
                raise EngineError(f"{target} or its audit exists already")
            os.replace(audit_file, audit)
            os.replace(part_file, target)
        finally:
            if os.path.exists(audit_file):
                os.unlink(audit_file)
    finally:
        if os.path.exists(part_file):
            os.unlink(part_file)
    return book._told(report | {"audit": str(audit)})


def _digest(path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _cells(book, sheet: str, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], dict]:
    rows, cols = [r for r, _ in wanted], {c for _, c in wanted}
    area = refs.Area(min(rows), min(cols), max(rows), max(cols))
    out = {at: {"value": None, "formula": None, "style": 0, "group": False} for at in wanted}
    with book.package.open_part(book.package.sheet(sheet).part) as f:
        for c in scan(f, area, cols):
            if (c.row, c.col) in wanted:
                formula = "=" + (c.formula or "") if c.formula is not None or c.f_type else None
                out[c.row, c.col] = {"value": value_of(c, book.strings), "formula": formula, "style": c.style, "group": bool(c.f_type) and c.f_type != "normal"}
    return out


def _verify(book, path: str, replaced: dict[str, bytes], dropped: set[str], expected: dict[str, dict]) -> None:
    """Read the new file back: members, identities, checksums of what stays, and every edited cell."""
    old: Package = book.package
    new = type(book)(path)
    try:
        p = new.package
        if set(p.parts) != set(old.parts) - dropped:
            raise EngineError("the output has other parts than the source")
        if list(p.sheets) != list(old.sheets) or {k: (t.sheet, t.area) for k, t in p.tables.items()} != {k: (t.sheet, t.area) for k, t in old.tables.items()} or p.names != old.names:
            raise EngineError("the output has other sheets, tables or names")
        for name, info in p.parts.items():
            if name not in replaced and (info.CRC, info.file_size) != (old.parts[name].CRC, old.parts[name].file_size):
                raise EngineError(f"part {name!r} has changed")
        for sheet, cells in expected.items():
            for at, got in _cells(new, sheet, set(cells)).items():
                want = cells[at]
                if (got["value"], got["formula"], got["style"]) != (want["value"], want["formula"], want["style"]):
                    raise EngineError(f"{refs.name(*at)} reads back as {got}")
    finally:
        p.close()

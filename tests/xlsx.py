"""A small writer of workbooks for tests."""

import zipfile
from xml.sax.saxutils import escape, quoteattr

from quillgrid.functions import refs

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


class F:
    """A formula with an optional stored value."""

    def __init__(self, text, value=None, attrs=""):
        self.text, self.value, self.attrs = text, value, attrs


class E:
    """A stored error."""

    def __init__(self, text):
        self.text = text


def cell(ref, v, strings=None, style=0):
    s = f' s="{style}"' if style else ""
    if v is None:
        return f'<c r="{ref}"{s}/>' if style else ""
    if isinstance(v, F):
        value = f"<v>{escape(str(v.value))}</v>" if v.value is not None else ""
        kind = ' t="str"' if isinstance(v.value, str) else ""
        return f'<c r="{ref}"{s}{kind}><f{v.attrs}>{escape(v.text)}</f>{value}</c>'
    if isinstance(v, E):
        return f'<c r="{ref}"{s} t="e"><v>{v.text}</v></c>'
    if isinstance(v, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"{s}><v>{v!r}</v></c>'
    if strings is not None:
        return f'<c r="{ref}"{s} t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'


def sheet_xml(rows, strings=None, styles=None, hidden_rows=(), head="", tail="", first=1):
    """rows: a list of lists, or a dict {(row, col): value}."""
    cells = rows if isinstance(rows, dict) else {(first + i, 1 + j): v for i, r in enumerate(rows) for j, v in enumerate(r)}
    by_row = {}
    for (r, c), v in sorted(cells.items()):
        by_row.setdefault(r, []).append(cell(refs.name(r, c), v, strings, (styles or {}).get(refs.name(r, c), 0)))
    body = "".join(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r in hidden_rows else ""}>{"".join(x)}</row>' for r, x in by_row.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}" xmlns:r="{REL}">{head}<sheetData>{body}</sheetData>{tail}</worksheet>'


STYLES = f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><fonts count="2"><font><sz val="11"/></font><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164" fontId="1"><alignment horizontal="center"/></xf><xf numFmtId="14"/></cellXfs></styleSheet>'


def write(path, sheets, shared=False, tables=(), names=(), states=None, styles=None, hidden_rows=None, head=None, tail=None, raw=None, extra=None, calc_chain=None):
    """sheets: {name: rows}; tables: (name, sheet, ref, columns, totals); raw: {name: worksheet bytes}; extra: {part: bytes}."""
    strings = {} if shared else None
    parts, rels, listed, types = {}, [], [], []
    for i, (name, rows) in enumerate(sheets.items(), 1):
        own = [(k, t) for k, t in enumerate(tables, 1) if t[1] == name]
        end = (tail or {}).get(name, "")
        if own:
            end += f'<tableParts count="{len(own)}">' + "".join(f'<tablePart r:id="t{k}"/>' for k, _ in own) + "</tableParts>"
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = f'<Relationships xmlns="{PKG}">' + "".join(f'<Relationship Id="t{k}" Type="{REL}/table" Target="../tables/table{k}.xml"/>' for k, _ in own) + "</Relationships>"
            for k, (tname, _, ref, columns, totals) in own:
                parts[f"xl/tables/table{k}.xml"] = f'<table xmlns="{MAIN}" id="{k}" name="{tname}" displayName="{tname}" ref="{ref}" totalsRowCount="{totals}"><tableColumns>' + "".join(f"<tableColumn id=\"{n}\" name={quoteattr(c)}/>" for n, c in enumerate(columns, 1)) + "</tableColumns></table>"
        data = (raw or {}).get(name)
        parts[f"xl/worksheets/sheet{i}.xml"] = data if data is not None else sheet_xml(rows, strings, (styles or {}).get(name), (hidden_rows or {}).get(name, ()), (head or {}).get(name, ""), end)
        rels.append(f'<Relationship Id="s{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
        state = (states or {}).get(name)
        listed.append(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"{f" state={quoteattr(state)}" if state else ""}/>')
        types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    rels.append(f'<Relationship Id="st" Type="{REL}/styles" Target="styles.xml"/>')
    parts["xl/styles.xml"] = STYLES
    if shared:
        rels.append(f'<Relationship Id="ss" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/>')
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    if calc_chain:
        rels.append(f'<Relationship Id="cc" Type="{REL}/calcChain" Target="calcChain.xml"/>')
        parts["xl/calcChain.xml"] = f'<calcChain xmlns="{MAIN}">' + "".join(f'<c r="{c}" i="1"/>' for c in calc_chain) + "</calcChain>"
        types.append('<Override PartName="/xl/calcChain.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.calcChain+xml"/>')
    defined = "".join(f"<definedName name={quoteattr(n)}>{escape(f)}</definedName>" for n, f in names)
    parts["xl/workbook.xml"] = f'<?xml version="1.0"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(listed)}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}<calcPr calcId="191029"/></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PKG}">{"".join(rels)}</Relationships>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{PKG}"><Relationship Id="r" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{"".join(types)}</Types>'
    parts |= extra or {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, data in parts.items():
            z.writestr(part, data)
    return path


DEPOTS = ("Kiel", "Lyon", "Oslo")
#: (depot, carrier, tonnes, fare) of the freight list, in sheet rows 4 to 63.
FREIGHT = [(DEPOTS[k * k % 3], f"carrier {k % 7:02d}", 3 * k + 1, 40 - k // 2) for k in range(60)]


def freight(path):
    """A freight list under two title rows with a total a row, a sheet of tariffs, and a sheet that is very hidden."""
    cells = {(1, 1): "Freight of the northern depots", (2, 1): "all weights in tonnes"}
    header = ["Depot", "Carrier", "Tonnes", "Fare", "Total", "Note"]
    cells |= {(3, j): h for j, h in enumerate(header, 1)}
    for r, (depot, carrier, tonnes, fare) in enumerate(FREIGHT, 4):
        cells |= {(r, 1): depot, (r, 2): carrier, (r, 3): tonnes, (r, 4): fare, (r, 5): F(f"C{r}*D{r}", tonnes * fare if r % 2 else None)}
    cells[30, 6] = "weighed twice"
    tariffs = {(2, 2): "Fuel surcharge", (2, 3): 0.15, (3, 2): "Toll per tonne", (3, 3): 1.75, (5, 2): "Notes of the board", (9, 3): F("C2+C3"), (25, 8): "surcharge review in spring"}
    head = '<dimension ref="A1:F63"/><sheetViews><sheetView workbookViewId="0"><pane xSplit="1" ySplit="3" topLeftCell="B4" state="frozen"/></sheetView></sheetViews><cols><col min="2" max="3" hidden="1"/></cols>'
    return write(
        path, {"Tariffs": tariffs, "Freight": cells, "Vault": [["do not open"]]}, tables=[("Loads", "Freight", "A3:F63", header, 0)], names=[("Surcharge", "Tariffs!$C$2"), ("Toll", "Tariffs!$C$3")],
        states={"Vault": "veryHidden"}, styles={"Tariffs": {"C2": 1, "C9": 2}}, hidden_rows={"Freight": {12, 13, 40}}, head={"Freight": head}, tail={"Tariffs": '<mergeCells count="1"><mergeCell ref="B5:E6"/></mergeCells>'},
    )

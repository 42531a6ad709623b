import io
import json
import zipfile

import pytest
import xlsx as X

from quillgrid import EngineError, UnsupportedError, Workbook
from quillgrid.patch import archive


def op(kind, cell, sheet="Tariffs", **k):
    return {"operation": kind, "sheet": sheet, "cell": cell, **k}


@pytest.fixture
def model(tmp_path):
    return X.freight(tmp_path / "m.xlsx")


def test_patch_keeps_other_bytes(model, tmp_path):
    out = tmp_path / "o.xlsx"
    ops = [
        op("SET_VALUE", "C2", value=0.2, expected=0.15), op("SET_STYLE", "C2", style_id=2), op("SET_FORMULA", "D2", formula="=C2*C3"), op("COPY_FORMULA", "D9", source_cell="C9"),
        op("SET_VALUE", "A40", value="=text & <more>"), op("SET_VALUE", "B3", value=None), op("SET_VALUE", "C3", value=False), op("COPY_STYLE", "E2", source_cell="C2"),
        op("COPY_FORMULA", "D10", source_sheet="Freight", source_cell="E6"), op("COPY_STYLE", "F5", "Freight", source_sheet="Tariffs", source_cell="C9"),
    ]
    with Workbook(model) as w:
        told = w.patch_cells(ops, out)
        assert told["changed_cells"] == 9 and told["recalculation_requested"]
        with pytest.raises(EngineError, match="exists"):
            w.patch_cells(ops, out)
    with Workbook(out) as w:
        assert w.read_range("Tariffs", "B2:C3")["rows"] == [["Fuel surcharge", 0.2], [None, False]]
        formulas = {f["cell"]: f["formula"] for f in w.get_formulas("Tariffs", "C2:D10")}
        assert formulas == {"D2": "=C2*C3", "C9": "=C2+C3", "D9": "=D2+D3", "D10": "=B10*C10"}
        assert w.read_cells("Tariffs", ["A40"])[0]["value"] == "=text & <more>"
        assert [w.get_cells("Tariffs", c)[0]["style"] for c in ("C2:C2", "E2:E2")] == [2, 1] and w.get_cells("Freight", "F5:F5")[0]["style"] == 2
        assert w.package.calculation["fullCalcOnLoad"] == "1"
    with zipfile.ZipFile(model) as a, zipfile.ZipFile(out) as b:
        assert a.namelist() == b.namelist()
        for n in a.namelist():
            assert (a.read(n) == b.read(n)) != (n in ("xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/workbook.xml"))
        members = len(b.namelist())
    audit = json.loads((tmp_path / "o.xlsx.audit.json").read_text())
    assert audit["changes"][0]["before"]["value"] == 0.15 and len(audit["compressed_records"]) == members - 3


def test_style_only_edits_do_not_recalculate(model, tmp_path):
    with Workbook(model) as w:
        assert not w.patch_cells([op("SET_STYLE", "C2", style_id=0)], tmp_path / "o.xlsx")["recalculation_requested"]
    with Workbook(tmp_path / "o.xlsx") as w:
        assert "fullCalcOnLoad" not in w.package.calculation


def test_calculation_chain_is_removed(tmp_path):
    path = X.write(tmp_path / "c.xlsx", {"S": [[1, X.F("A1", 1)]]}, calc_chain=["B1"])
    with Workbook(path) as w:
        told = w.patch_cells([op("SET_VALUE", "A1", "S", value=5)], tmp_path / "o.xlsx")
        assert told["removed_parts"] == ["xl/calcChain.xml"]
    with zipfile.ZipFile(tmp_path / "o.xlsx") as z:
        assert b"calcChain" not in z.read("[Content_Types].xml") + z.read("xl/_rels/workbook.xml.rels")


@pytest.mark.parametrize(
    "bad",
    [
        [], [op("SET_VALUE", "C2", value=float("nan"))], [op("SET_VALUE", "C2", value="x" * 32768)], [op("SET_VALUE", "C2", value=[1])], [op("SET_FORMULA", "C2", formula="C3")], [op("SET_FORMULA", "C2", formula="=")],
        [op("SET_STYLE", "C2", style_id=99)], [op("SET_STYLE", "C2", style=1)], [op("SET_VALUE", "C6", value=1)], [op("SET_VALUE", "A3", "Freight", value="x")], [op("SET_VALUE", "C2", value=1), op("SET_FORMULA", "C2", formula="=1")],
        [op("SET_VALUE", "C2", value=1, expected=0.5)], [op("SET_VALUE", "C9", value=1, expected_formula="=C2")], [op("COPY_FORMULA", "D1", source_cell="B2")], [op("COPY_FORMULA", "D1", source_cell="C9", source_sheet="Nope")],
        [op("SET_VALUE", "C2", "Nope", value=1)], [op("ERASE", "C2")], [op("SET_VALUE", "C2", value=1, extra=2)], [op("SET_VALUE", "C2", value=1, source_sheet="Freight")],
    ],
)
def test_refusals_write_nothing(model, tmp_path, bad):
    with Workbook(model) as w, pytest.raises(EngineError):
        w.patch_cells(bad, tmp_path / "o.xlsx")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.xlsx"]


def test_formula_groups_and_paths(tmp_path):
    path = X.write(tmp_path / "g.xlsx", {"S": [[1, X.F("A1", 1, ' t="shared" ref="B1:B2" si="0"')], [2, X.F("", 2, ' t="shared" si="0"')]]})
    with Workbook(path) as w:
        for cell in ("B1", "B2"):
            with pytest.raises(UnsupportedError):
                w.patch_cells([op("SET_VALUE", cell, "S", value=1)], tmp_path / "o.xlsx")
        for target in (path, tmp_path / "o.xlsm"):
            with pytest.raises(EngineError):
                w.patch_cells([op("SET_VALUE", "A1", "S", value=1)], target)
        assert w.get_dependencies("S", "B1:B2")[1]["complete"] is False


def test_write_range(model, tmp_path):
    with Workbook(model) as w:
        w.write_range("Tariffs", "H1", [[1, "a"], [2, "b"]], tmp_path / "o.xlsx")
    with Workbook(tmp_path / "o.xlsx") as w:
        assert w.read_range("Tariffs", "H1:I2")["rows"] == [[1, "a"], [2, "b"]]


def test_archive_copies_records_with_data_descriptors(tmp_path):
    class Unseekable(io.RawIOBase):
        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    out = Unseekable()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"note"
        z.writestr("a.txt", b"a" * 5000)
        z.writestr("b.txt", b"b")
        with z.open("c.txt", "w", force_zip64=True) as f:
            f.write(b"c" * 100)
    path = tmp_path / "z.zip"
    path.write_bytes(bytes(out.data))
    with open(tmp_path / "o.zip", "wb") as f:
        told = archive.copy(str(path), f, {"b.txt": b"new"})
    assert set(told) == {"a.txt", "c.txt"}
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.testzip() is None and z.read("b.txt") == b"new" and z.read("a.txt") == b"a" * 5000 and z.read("c.txt") == b"c" * 100 and z.comment == b"note"

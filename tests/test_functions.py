import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.budget import Budget, compact
from quillgrid.errors import BudgetError, EngineError
from quillgrid.functions import casts, formulas, refs


@given(st.integers(1, refs.MAX_ROW), st.integers(1, refs.MAX_COL))
def test_references_round_trip(row, col):
    assert refs.cell(refs.name(row, col)) == (row, col)
    assert refs.cell("$" + refs.column_letters(col) + "$" + str(row)) == (row, col)


@pytest.mark.parametrize("bad", ["", "A0", "A1048577", "XFE1", "1A", "A", "A1:B2:C3", None])
def test_bad_references(bad):
    with pytest.raises(EngineError):
        refs.cell(bad)


def test_areas():
    a = refs.area("$B$2:D5")
    assert (a.rows, a.columns, a.cells, str(a)) == (4, 3, 12, "B2:D5")
    assert (3, 4) in a and (6, 4) not in a
    with pytest.raises(EngineError):
        refs.area("B2:A1")


@given(st.integers(1, 500), st.integers(1, 200), st.integers(1, 500), st.integers(1, 200))
def test_copied_formulas_have_one_relative_form(r, c, down, right):
    text = f"SUM({refs.name(r, c)}:{refs.name(r + 2, c)})*$A$1&\"A1\"&'It''s'!{refs.name(r, c)}"
    moved = formulas.translate(text, (r, c), (r + down, c + right))
    assert formulas.relative(moved, r + down, c + right) == formulas.relative(text, r, c)
    assert '"A1"' in moved and "$A$1" in moved


def test_precedents():
    assert formulas.precedents("SUM(A1:B2)+'My Sheet'!$C$3*A1:B2+Growth+LOG10(D4)") == (["A1:B2", "'My Sheet'!$C$3", "Growth", "D4"], True)
    assert formulas.precedents('INDIRECT("A1")+B2') == (["B2"], False)
    assert formulas.precedents("Sales[Revenue]+TRUE") == (["Sales[Revenue]"], True)
    assert formulas.translate("A1", (2, 1), (1, 1)) == "#REF!"


@pytest.mark.parametrize("bad", ["TEXT", "DECIMAL(10, 2)", "DECIMAL(39,2)", "DECIMAL(4,5)", "INT", ""])
def test_unknown_types(bad):
    with pytest.raises(EngineError):
        casts.parse_type(bad)


def test_casts(spark):
    def cast(kind, *texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r[0] for r in rows.select(casts.from_text(rows.t, casts.parse_type(kind)).alias("v")).collect()]

    assert cast("bigint", "1.5", "2.5", "-2.5", "1E3", "9007199254740993", None) == [2, 3, -3, 1000, 9007199254740993, None]
    assert cast("varchar", "0001", "") == ["0001", ""]
    assert [str(x) for x in cast("decimal(38,20)", "0.10000000000000000001")] == ["0.10000000000000000001"]
    assert cast("boolean", "True", "f") == [True, False]
    assert str(cast("date", "2024-02-29")[0]) == "2024-02-29"
    for kind, text in [("date", "45000"), ("date", "01/02/2024"), ("bigint", ""), ("double", "x"), ("timestamp", "7")]:
        with pytest.raises(Exception):  # noqa: B017
            cast(kind, text)


def test_compact_json():
    budget = Budget(max_chars=20)
    assert compact({"a": "é"}, budget) == '{"a":"é"}'
    with pytest.raises(BudgetError):
        compact("x" * 30, budget)
    with pytest.raises(EngineError):
        compact(float("nan"), budget)


@settings(max_examples=30)
@given(st.text(max_size=40))
def test_formula_pieces_cover_the_text(text):
    assert "".join(m[0] for m in formulas._pieces(text)) == text
    assert re.sub(r"\s", "", formulas.translate(text, (5, 5), (5, 5))).upper() == re.sub(r"\s", "", text).upper()

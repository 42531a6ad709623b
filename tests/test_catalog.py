import duckdb
import pytest

from quillgrid.functions import refs
from quillgrid.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def norm(v):
    return "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


def test_reconciles_tables_beyond_a_sheet(spark, sf, duck, monkeypatch):
    """Every sheet's table has more rows than a sheet holds here; it goes on over further sheets, and the rows keep its name."""
    monkeypatch.setattr(refs, "MAX_ROW", 120)
    rows = catalog.QUERIES["workbook_reconcile"](spark, sf)
    want = duck.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in rows.columns)} FROM ({catalog.ORACLE["workbook_reconcile"]}) ORDER BY line').fetchall()
    assert sorted(tuple(r) for r in rows.collect()) == want and len(want) > 119


def test_reads_any_number_of_cells(spark, tmp_path):
    """More cells of a sheet are asked for than a list may have."""
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT i AS c_custkey, i % 2 + 3 AS c_nationkey, (i / 4)::DOUBLE AS c_acctbal, 'M' || i % 5 AS c_mktsegment FROM range(7000) r(i); CREATE TABLE nation AS SELECT unnest([3, 4, 5]) AS n_nationkey")
    for t in ("customer", "nation"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["workbook_sparse"](spark, str(tmp_path)).collect())
    assert got == c.execute(f"SELECT place, cell, value FROM ({catalog.ORACLE['workbook_sparse']}) ORDER BY place").fetchall() and len(got) == 10500


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(name, spark, sf, duck):
    rows = catalog.QUERIES[name](spark, sf)
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(rows.columns)
    at = [names.index(c) for c in rows.columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in rows.collect()) == want

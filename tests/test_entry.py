import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from pyspark.sql import functions as F

from quillgrid import BudgetError, EngineError, Workbook
from quillgrid.sources.export import write_parts, write_workbook

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and rows.columns[0] == "kind"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_without_the_text_operators(tmp_path):
    """Without those folders and the pipeline everything else imports, and the other queries are there."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, quillgrid, quillgrid.cli; q = e.queries(); assert 'reconcile_changes' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_export_bound(spark, tmp_path):
    assert write_workbook(str(tmp_path / "a.xlsx"), {"S": spark.range(5)}) == {"S": "A1:A6"}
    with pytest.raises(BudgetError):
        write_workbook(str(tmp_path / "b.xlsx"), {"S": spark.range(5)}, most=4)
    assert [p.name for p in tmp_path.iterdir()] == ["a.xlsx"]


def test_parts_hold_all_rows(spark, tmp_path):
    """Tables of several tasks, of more rows than a sheet may have, without rows, and with names that numbered ones would take."""
    long = "a table whose name fills a sheet"[:31]
    text = F.when(F.col("ID") % 5 != 0, F.concat(F.lit("<&> "), F.col("ID").cast("string")))
    many = spark.range(0, 23, numPartitions=3).select(F.col("id").alias("ID"), (F.col("id") / 4).cast("decimal(9,2)").alias("V"))
    tables = {"S": many.withColumn("T", text), "S (2)": many.limit(1).withColumn("T", text).select("T", "V", "ID"), "none": many.where("ID < 0").withColumn("T", text), long: many.where("ID > 12").withColumn("T", text)}
    path = str(tmp_path / "a.xlsx")
    ranges = write_parts(path, tables, most=4)
    assert list(ranges) == list(tables) and ranges["S"].keys() == {"S", *(f"S ({i})" for i in range(3, 8))} and ranges["S (2)"] == {"S (2)": "A1:C2"} and ranges["none"] == {"none": "A1:C1"}
    assert [p.name for p in tmp_path.iterdir()] == ["a.xlsx"] and all(len(s) <= 31 for own in ranges.values() for s in own) and len(ranges[long]) > 1
    with Workbook(path, spark) as book:
        book.load_sheets("Rows", ranges, {"ID": "BIGINT", "V": "DECIMAL(9,2)", "T": "VARCHAR"})
        got = [tuple(r) for r in book.relation("Rows").collect()]
        assert [c["value"] for c in book.read_cells("S", ["A2", "A5", "B5"])] == [0, 3, 0.75]
        with pytest.raises(EngineError):
            book.load_sheets("Rows", {"S": {}}, {"ID": "BIGINT"})
    want = [(r["ID"], r["V"], r["T"], name) for name, rows in tables.items() for r in rows.collect()]
    key = lambda r: (r[3], r[0])
    assert sorted(got, key=key) == sorted(want, key=key)

"""The search and formula index of a workbook's sheets: tables of labels and of formula runs."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas, refs
from ..sources import xlsx
from ..sources.package import Package
from . import discovery, search

VERSION = 2


def relative_forms(cells: DataFrame) -> DataFrame:
    """Formula cells (sheet, row, col, formula) with `pattern`, the formula relative to its cell.

    A cell that shares a formula without spelling it gets the pattern of the cell that does.
    """

    @F.pandas_udf("string")
    def form(formula: pd.Series, row: pd.Series, col: pd.Series) -> pd.Series:
        return pd.Series([formulas.relative(f, r, c) for f, r, c in zip(formula, row, col)], dtype="object")

    own = cells.where("formula is not null or f_type is not null")
    spelt = own.where("coalesce(formula, '') != ''").withColumn("pattern", form("formula", "row", "col"))
    masters = spelt.where("f_type = 'shared' and f_si is not null").groupBy("sheet", "f_si").agg(F.min_by("pattern", F.struct("row", "col")).alias("pattern"), F.min_by("formula", F.struct("row", "col")).alias("formula"))
    follow = own.where("coalesce(formula, '') = ''").drop("formula").join(masters, ["sheet", "f_si"], "left")
    follow = follow.withColumn("pattern", F.coalesce("pattern", F.concat(F.lit("?"), "ref")))
    columns = ["sheet", "row", "col", "formula", "pattern"]
    return spelt.select(columns).unionByName(follow.select(columns))


class Index:
    """Tables derived from cells, kept as Parquet by the signature of each sheet."""

    def __init__(self, spark: SparkSession, package: Package, folder: str):
        self.spark, self.package, self.folder = spark, package, folder
        os.makedirs(folder, exist_ok=True)

    def _key(self, sheet: str) -> str:
        s = self.package.sheet(sheet)
        tables = [self.package.tables[t].part for t in s.tables]
        content = self.package.signature(s.part, self.package.strings_part, *tables)
        return hashlib.sha256(json.dumps([VERSION, sheet, s.state, content]).encode()).hexdigest()

    def _kept(self, kind: str, sheet: str, make) -> DataFrame:
        """A derived table of a sheet, made once for each state of the sheet."""
        path = os.path.join(self.folder, f"{kind}-{self._key(sheet)}.parquet")
        if not os.path.exists(os.path.join(path, "_SUCCESS")):
            part = os.path.join(self.folder, f".{uuid.uuid4().hex}")
            try:
                make().write.option("compression", "zstd").parquet(part)
                shutil.rmtree(path, ignore_errors=True)
                os.rename(part, path)
            finally:
                shutil.rmtree(part, ignore_errors=True)
        return self.spark.read.parquet(path)

    def cells(self, sheet: str) -> DataFrame:
        """The cells of a sheet, for tables that are derived from them."""
        return self._kept("cells", sheet, lambda: xlsx.cells(self.spark, self.package.path, [(sheet, None)]))

    def labels(self, sheet: str) -> DataFrame:
        """(sheet, ref, kind, text, tokens) of the cells that hold text and no formula or error."""

        def make():
            cells = self.cells(sheet).where("kind in ('s', 'str', 'inlineStr') and formula is null and f_type is null and trim(value_text) != ''")
            told = search.labels(cells)
            keys = ["sheet", "ref", "kind", "text"]
            return search.unicode_tokens(told.select("sheet", "ref", told["kind"], "text"), keys, "text")

        return self._kept("labels", sheet, make)

    def find(self, query: str, sheets: list[str] | None, limit: int, full: bool) -> list[dict]:
        """The best labels for any word of the query; frequencies are over all sheets of the workbook."""
        every = [s for s in self.package.sheets if s]
        phrases = [t for t in map(search.tokens, re.findall(r"\w+", query)) if t]
        if not phrases or not every:
            return []
        labels = functools.reduce(DataFrame.unionByName, map(self.labels, every))
        ranked = search.bm25(labels if full else labels.where("kind != 'body'"), None, ["sheet", "ref", "kind", "text"], phrases)
        if sheets is not None:
            ranked = ranked.where(F.col("sheet").isin(list(sheets)))
        best = ranked.orderBy("score", "sheet", "ref").limit(limit).collect()
        return [{"sheet": r.sheet, "cell": r.ref, "kind": r.kind, "text": r.text, "score": r.score} for r in best]

    def runs(self, sheet: str) -> DataFrame:
        """(col, pattern, first_row, last_row, n, example) of the maximal runs of one formula down a column."""

        def make():
            told = relative_forms(self.cells(sheet))
            found = discovery.runs(told.select("col", "pattern", "row"), ["col", "pattern"], "row")
            heads = told.select("col", F.col("row").alias("first_row"), F.col("formula").alias("example"))
            return found.join(heads, ["col", "first_row"])

        return self._kept("runs", sheet, make)

    def patterns(self, sheet: str, limit: int, offset: int) -> list[dict]:
        top = self.runs(sheet).orderBy(F.desc("n"), "first_row", "col").offset(offset).limit(limit).collect()
        return [{"range": f"{refs.name(r.first_row, r.col)}:{refs.name(r.last_row, r.col)}", "example": f"={r.example}", "count": r.n} for r in top]

    def groups(self, sheet: str) -> DataFrame:
        """(range, type, anchor, row, col) of the formulas that are spelt once for a range: shared, arrays and data tables."""
        cells = self.cells(sheet).where("f_ref is not null")
        return cells.select(F.col("f_ref").alias("range"), F.col("f_type").alias("type"), F.col("ref").alias("anchor"), "row", "col")

    def headers(self, sheet: str, rows: int, labels: int, chars: int) -> list[dict]:
        """The first rows of the first 20 that hold text, with their first texts, cut to so many characters."""
        cells = self.cells(sheet).where("row <= 20 and kind in ('s', 'str', 'inlineStr') and formula is null and trim(value_text) != ''")
        nth = F.row_number().over(Window.partitionBy("row").orderBy("col"))
        first = cells.withColumn("nth", nth).where(F.col("nth") <= labels).select("row", "col", F.substring("value_text", 1, chars).alias("text"))
        by_row: dict[int, list[str]] = {}
        for r in first.orderBy("row", "col").limit(20 * labels).collect():  # at most all of 20 rows
            by_row.setdefault(r.row, []).append(r.text)
        return [{"row": r, "labels": texts} for r, texts in list(by_row.items())[:rows]]

    def summary(self, sheet: str) -> dict:
        cells = self.cells(sheet)
        one = cells.agg(
            F.count_if(F.expr("value_text is not null or formula is not null or f_type is not null")).alias("nonempty"),
            F.count_if(F.expr("formula is not null or f_type is not null")).alias("formulas"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"),
        ).first()
        styles = {r.style: r.cells for r in discovery.style_counts(cells).orderBy("style").collect()}
        return {"nonempty_cells": one.nonempty, "formula_cells": one.formulas, "used_range": None if one.top is None else str(refs.Area(one.top, one.left, one.bottom, one.right)), "style_counts": styles}

"""The `xlsx` data source: typed-text projections and cells of worksheets, one partition a sheet or range.

Options: path, ranges (JSON list of [sheet, range, [column index, ...]]), columns (JSON list of names),
formulas (reject or cached), mode (projection or cells). Spark does not push column selection into
Python sources, so the columns to decode are an option; one worksheet is one compressed stream, so it is
read by one task. The path must be readable on the executors.
"""

from __future__ import annotations

import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import refs
from .cells import lookup, projected, scan, text_of
from .package import Package, shared_strings

BATCH = 20_000
CELLS = T.StructType([
    T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("value_text", T.StringType()), T.StructField("style", T.IntegerType()), T.StructField("formula", T.StringType()), T.StructField("f_type", T.StringType()), T.StructField("f_ref", T.StringType()), T.StructField("f_si", T.StringType()),
])


class SheetPart(InputPartition):
    def __init__(self, sheet: str, part: str, strings: str | None, area: str | None, indices: list[int]):
        self.sheet, self.part, self.strings, self.area, self.indices = sheet, part, strings, area, indices


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, parts: list[SheetPart]):
        self.path, self.mode = options["path"], options.get("mode", "projection")
        self.cached = options.get("formulas", "reject") == "cached"
        self.columns = json.loads(options.get("columns", "[]"))
        self.parts = parts

    def partitions(self):
        return self.parts

    def read(self, partition: SheetPart):
        with zipfile.ZipFile(self.path) as archive:
            strings: list[str] = []
            if partition.strings:
                with archive.open(partition.strings) as f:
                    strings = shared_strings(f)
            get = lookup(strings)
            area = refs.area(partition.area) if partition.area else None
            with archive.open(partition.part) as f:
                yield from (self._cells(f, partition, area, get) if self.mode == "cells" else self._rows(f, partition, area, get))

    def _cells(self, stream, partition, area, get):
        rows: list[tuple] = []
        schema = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in CELLS])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for c in scan(stream, area):
            rows.append((partition.sheet, c.row, c.col, c.ref, c.kind, text_of(c, get), c.style, c.formula, c.f_type, c.f_ref, c.f_si))
            if len(rows) >= BATCH:
                yield out()
                rows.clear()
        if rows:
            yield out()

    def _rows(self, stream, partition, area, get):
        """Dense rows: those without cells are all null."""
        place = {c: i for i, c in enumerate(partition.indices)}
        width = len(partition.indices)
        schema = pa.schema([*((n, pa.string()) for n in self.columns), ("_sheet", pa.string()), ("_row", pa.int32())])
        rows: list[list] = []
        now, current = area.top, [None] * width

        def out():
            cols = list(zip(*rows))
            arrays = [pa.array(c, pa.string()) for c in cols[:width]]
            batch = pa.RecordBatch.from_arrays([*arrays, pa.array([partition.sheet] * len(rows)), pa.array(cols[-1], pa.int32())], schema=schema)
            rows.clear()
            return batch

        for c in scan(stream, area, set(place)):
            while now < c.row:
                rows.append([*current, now])
                now, current = now + 1, [None] * width
                if len(rows) >= BATCH:
                    yield out()
            current[place[c.col]] = projected(c, get, self.cached)
        while now <= area.bottom:
            rows.append([*current, now])
            now, current = now + 1, [None] * width
            if len(rows) >= BATCH:
                yield out()
        if rows:
            yield out()


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        if self.options.get("mode") == "cells":
            return CELLS
        return T.StructType([*(T.StructField(c, T.StringType()) for c in json.loads(self.options["columns"])), T.StructField("_sheet", T.StringType()), T.StructField("_row", T.IntegerType())])

    def reader(self, schema):
        package = Package(self.options["path"])
        try:
            parts = []
            for sheet, area, indices in json.loads(self.options["ranges"]):
                parts.append(SheetPart(sheet, package.sheet(sheet).part, package.strings_part, area, indices))
        finally:
            package.close()
        return XlsxReader(dict(self.options), parts)


def _options(spark: SparkSession, path: str, **options):
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v if isinstance(v, str) else json.dumps(v))
    return reader


def projection(spark: SparkSession, path: str, ranges: list[tuple[str, str, list[int]]], columns: list[str], cached_formulas: bool = False) -> DataFrame:
    """(columns as text, _sheet, _row) of data ranges, without their header rows."""
    return _options(spark, path, ranges=ranges, columns=columns, formulas="cached" if cached_formulas else "reject").load()


def cells(spark: SparkSession, path: str, ranges: list[tuple[str, str | None]]) -> DataFrame:
    """The cells of sheets or ranges, one row a cell that the file has."""
    return _options(spark, path, ranges=[[s, a, []] for s, a in ranges], mode="cells").load()

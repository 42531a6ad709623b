"""Typed projections of sheet ranges: scan, convert, keep as Parquet under a content signature.

A projection's signature covers the checksums of the sheet and of the shared strings, the range, the
columns with their types, and the formula policy, so edits elsewhere in the workbook leave it valid. A
table is written beside its place and renamed; a damaged one is rebuilt.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, told
from ..functions import casts, refs
from . import xlsx
from .cells import lookup, scan, value_of
from .package import Package, shared_strings

VERSION = 1


@dataclass(frozen=True)
class Projection:
    """What is read: one range of one sheet, its columns with types, and the formula policy."""

    sheet: str
    area: refs.Area  # with the header row
    columns: tuple[str, ...]
    types: tuple[str, ...]
    indices: tuple[int, ...]  # sheet columns
    cached_formulas: bool

    @property
    def data(self) -> refs.Area | None:
        a = self.area
        return refs.Area(a.top + 1, a.left, a.bottom, a.right) if a.rows > 1 else None

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, casts.parse_type(t)) for c, t in zip(self.columns, self.types)])


class Strings:
    """The shared strings of a package, read when first asked for."""

    def __init__(self, package: Package):
        self.package, self.get = package, None

    def __call__(self, i: int) -> str:
        if self.get is None:
            if not self.package.strings_part:
                raise EngineError("the package has no shared strings")
            with self.package.open_part(self.package.strings_part) as f:
                self.get = lookup(shared_strings(f))
        return self.get(i)


def headers(package: Package, sheet: str, area: refs.Area, strings: Strings) -> list[str]:
    """The texts of the first row: every column needs one, and no two are equal without case."""
    first = refs.Area(area.top, area.left, area.top, area.right)
    with package.open_part(package.sheet(sheet).part) as f:
        found = {c.col: value_of(c, strings) for c in scan(f, first)}
    out = [found.get(c) for c in range(area.left, area.right + 1)]
    for c in out:
        if not isinstance(c, str) or not c.strip():
            raise EngineError(f"sheet {sheet!r}: every column of the header row needs a text, not {c!r}")
    if len({c.casefold() for c in out}) < len(out):
        raise EngineError(f"sheet {sheet!r}: the header row repeats a name")
    return out


def plan(package: Package, strings: Strings, sheet: str, area: refs.Area, schema: dict[str, str] | None, columns: list[str] | None, cached_formulas: bool) -> Projection:
    names = headers(package, sheet, area, strings)
    chosen = list(columns) if columns is not None else list(schema) if schema else names
    if not chosen or len(set(chosen)) < len(chosen):
        raise EngineError("columns must be given, each once")
    for c in chosen:
        if c not in names:
            raise EngineError(f"sheet {sheet!r} has no column {c!r}")
    if schema is not None and set(schema) != set(chosen):
        raise EngineError("the schema must name the selected columns")
    types = [str((schema or {}).get(c, "VARCHAR")).upper() for c in chosen]
    for t in types:
        casts.parse_type(t)
    return Projection(sheet, area, tuple(chosen), tuple(types), tuple(area.left + names.index(c) for c in chosen), cached_formulas)


def signature(package: Package, p: Projection) -> str:
    content = package.signature(package.sheet(p.sheet).part, package.strings_part)
    what = [VERSION, content, p.sheet, str(p.area), p.columns, p.types, p.indices, p.cached_formulas]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()


def frames(spark: SparkSession, package: Package, wanted: list[Projection]) -> DataFrame:
    """The typed rows of projections of the same columns, one partition each, lazily; a value that does not fit raises when they are read."""
    p = wanted[0]
    names = [f"c{i}" for i in range(len(p.columns))]
    raw = xlsx.projection(spark, package.path, [[w.sheet, str(w.data), list(w.indices)] for w in wanted], names, p.cached_formulas)
    return raw.select(*(casts.from_text(F.col(n), casts.parse_type(t)).alias(c) for n, c, t in zip(names, p.columns, p.types)))


def frame(spark: SparkSession, package: Package, p: Projection) -> DataFrame:
    """The typed rows of a projection, lazily."""
    return spark.createDataFrame([], p.schema()) if p.data is None else frames(spark, package, [p])


class Store:
    """Parquet tables of projections in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def path(self, key: str) -> str:
        return os.path.join(self.folder, f"projection-{key}.parquet")

    def read(self, key: str, schema: T.StructType) -> DataFrame | None:
        """A kept table, or None if there is none that can be read."""
        path = self.path(key)
        if not os.path.exists(os.path.join(path, "_SUCCESS")):
            return None
        try:
            kept = self.spark.read.parquet(path)  # reads a footer
            if [(f.name, f.dataType) for f in kept.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
                return None
            return self.spark.read.schema(schema).parquet(path)
        except Exception:
            return None

    def rows(self, key: str) -> int:
        """The number of rows of a kept table, from the ends of its files."""
        return sum(pq.read_metadata(f.path).num_rows for f in os.scandir(self.path(key)) if f.name.startswith("part-"))

    def write(self, keys: list[str], rows: DataFrame, by: str | None = None) -> None:
        """Keep rows under a key, or under one key for each number in the column `by`, from one job."""
        part = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        try:
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(part)
            for i, key in enumerate(keys):
                made = os.path.join(part, f"{by}={i}") if by else part
                open(os.path.join(made, "_SUCCESS"), "w").close()
                if os.path.exists(self.path(key)):
                    shutil.rmtree(self.path(key))
                os.rename(made, self.path(key))
        finally:
            shutil.rmtree(part, ignore_errors=True)


def load(spark: SparkSession, package: Package, wanted: list[Projection], store: Store) -> tuple[list[DataFrame], int]:
    """Typed tables of the projections, and how many of them were kept already.

    Missing ones of the same columns are scanned, converted and written by one job, a task each.
    """
    keys = [signature(package, p) for p in wanted]
    kept = [store.read(k, p.schema()) for k, p in zip(keys, wanted)]
    groups: dict[tuple, list[int]] = {}
    for i in sorted({k: i for i, k in enumerate(keys) if kept[i] is None}.values()):
        p = wanted[i]
        groups.setdefault((p.columns, p.types, p.cached_formulas, p.data is None), []).append(i)
    with told():
        for (columns, _, _, empty), own in groups.items():
            first = wanted[own[0]]
            if empty:
                for i in own:
                    store.write([keys[i]], spark.createDataFrame([], first.schema()))
                continue
            place = _free("sheet", columns)
            rows = frames(spark, package, [wanted[i] for i in own]).withColumn(place, F.spark_partition_id())
            store.write([keys[i] for i in own], rows, place)
        hits = sum(rows is not None for rows in kept)
        return [rows if rows is not None else spark.read.schema(p.schema()).parquet(store.path(k)) for k, p, rows in zip(keys, wanted, kept)], hits


def _free(name: str, taken) -> str:
    """A column name that is not taken, compared without case."""
    while name in {c.casefold() for c in taken}:
        name += "_"
    return name


def stamps(store: Store, package: Package, wanted: list[Projection]) -> dict[str, tuple]:
    """Names, sizes and times of the files that hold the projections."""
    out = {}
    for p in wanted:
        path = store.path(signature(package, p))
        out[path] = tuple(sorted((f.name, f.stat().st_size, f.stat().st_mtime_ns) for f in os.scandir(path) if f.name.startswith("part-")))
    return out


def check_stamps(known: dict[str, tuple]) -> None:
    """Raise if a file that holds a projection has changed or gone."""
    for path, files in known.items():
        try:
            now = tuple(sorted((f.name, f.stat().st_size, f.stat().st_mtime_ns) for f in os.scandir(path) if f.name.startswith("part-")))
        except OSError:
            now = ()
        if now != files:
            raise EngineError(f"the kept table {path} has changed since it was loaded")

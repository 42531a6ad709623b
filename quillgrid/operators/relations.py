"""Named relations: registration, unions with provenance, bounded SQL, filters, materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..budget import Budget, Metrics, plain
from ..errors import EngineError, told
from ..plans import sqlguard
from .profiling import profile
from .reconcile import quoted


def bounded(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most one row more than the budget, which tells whether it is exceeded."""
    return rows.limit(max_rows + 1)


def filtered(rows: DataFrame, columns: list[str], filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """The columns of the rows that meet every equality; None asks for null. Without an order, any rows meet a limit."""
    known = set(rows.columns)
    for c in [*columns, *(filters or {})]:
        if c not in known:
            raise EngineError(f"unknown column {c!r}")
    for c, v in (filters or {}).items():
        if c not in columns:
            raise EngineError(f"filter column {c!r} is not among the columns")
        rows = rows.where(F.col(quoted(c)).isNull() if v is None else F.col(quoted(c)) == F.lit(v))
    out = rows.select(*map(quoted, columns))
    return out if limit is None else out.limit(limit)


def union_sheets(sheets: dict[str, DataFrame], columns: list[str], source: str = "_sheet") -> DataFrame:
    """Sheets aligned by column name, one below the other, with the sheet's name beside each row."""
    if not sheets or not columns:
        raise EngineError("a union needs sheets and columns")
    if source.casefold() in {c.casefold() for c in columns}:
        raise EngineError(f"the source column {source!r} is also a data column")
    out = None
    for name, rows in sheets.items():
        missing = [c for c in columns if c not in rows.columns]
        if missing:
            raise EngineError(f"sheet {name!r} has no column {missing[0]!r}")
        part = rows.select(*map(quoted, columns), F.lit(name).alias(source))
        out = part if out is None else out.unionByName(part)
    return out


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; keys with many rows are ranked after Spark's partial group limit."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(over)).where("_nth = 1").drop("_nth")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key that is not later; right's times are distinct for a key.

    One union and one window instead of a range join: rows of both sides are sorted together.
    """
    none = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    a = left.withColumn("_left", F.struct(*left.columns)).select(*keys, at, F.lit(1).alias("_side"), "_left", *none)
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *values)
    over = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(over)
    out = b.unionByName(a).withColumn("_seen", seen).where("_side = 1")
    return out.select("_left.*", *(F.col(f"_seen.{v}").alias(v) for v in values))


class Relations:
    """A registry of relations and the SQL over them. Names compare without case."""

    def __init__(self, spark: SparkSession, budget: Budget | None = None, metrics: Metrics | None = None):
        self.spark, self.budget, self.metrics = spark, budget or Budget(), metrics or Metrics()
        self._frames: dict[str, DataFrame] = {}
        self._names: dict[str, str] = {}
        self._views: dict[str, str] = {}
        self._kept: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        return sorted(self._names.values())

    def register(self, name: str, rows: DataFrame) -> None:
        """Publish rows under a name, in place of what had it; a materialised copy is dropped."""
        if not name or not isinstance(name, str):
            raise EngineError("a relation needs a name")
        key = name.casefold()
        view = f"_r{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        self.drop(name)
        self._frames[key], self._names[key], self._views[key] = rows, name, view

    def drop(self, name: str) -> None:
        key = name.casefold()
        if key in self._kept:
            self._kept.pop(key).unpersist()
        if key in self._views:
            self.spark.catalog.dropTempView(self._views.pop(key))
            self._frames.pop(key)
            self._names.pop(key)

    def relation(self, name: str) -> DataFrame:
        try:
            return self._frames[name.casefold()]
        except KeyError:
            raise EngineError(f"unknown relation {name!r}") from None

    def materialize(self, name: str) -> dict:
        """Keep a relation in memory and on disk for the session; a second call changes nothing."""
        key = name.casefold()
        rows = self.relation(name)
        if key in self._kept:
            return {"table": self._names[key], "materialized": True, "cached": True}
        kept = rows.persist()
        try:
            with told():
                kept.count()
        except Exception:
            kept.unpersist()
            raise
        self._kept[key] = kept
        return {"table": self._names[key], "materialized": True, "cached": False}

    def frame(self, sql: str, parameters: list | tuple | dict | None = None) -> DataFrame:
        """The rows of one SELECT over the registered relations, lazily."""
        with told(), sqlguard.dialect(self.spark):
            text = sqlguard.named_parameters(sql).strip().rstrip(";")
            sqlguard.admit(self.spark, text, set(self._views), {c for rows in self._frames.values() for c in rows.columns})
            named = ", ".join(f'"{self._names[k]}" AS (SELECT * FROM {v})' for k, v in self._views.items())
            whole = f"WITH {named} SELECT * FROM ({text}\n) AS answer" if named else f"SELECT * FROM ({text}\n) AS answer"
            args = list(parameters) if isinstance(parameters, (list, tuple)) else parameters
            return self.spark.sql(whole, args) if args else self.spark.sql(whole)

    def query(self, sql: str, parameters: list | tuple | dict | None = None) -> dict:
        """{columns, rows} of one SELECT within the budget; beyond it an error, never part of the rows."""
        with self.metrics.timed("query"):
            return self.answer(self.frame(sql, parameters))

    def answer(self, rows: DataFrame) -> dict:
        with told():
            got = bounded(rows, self.budget.max_rows).collect()
        self.budget.check(len(got), len(got) * len(rows.columns))
        return {"columns": rows.columns, "rows": [[plain(v) for v in r] for r in got]}

    def read_table(self, name: str, columns: list[str] | None = None, filters: dict | None = None, limit: int = 20) -> dict:
        if not 1 <= limit <= self.budget.max_rows:
            raise EngineError(f"limit must be 1 to {self.budget.max_rows}")
        rows = self.relation(name)
        return self.answer(filtered(rows, columns or rows.columns, filters, limit))

    def profile_table(self, name: str) -> dict:
        return self.answer(profile(self.relation(name)))


def sql(spark: SparkSession, tables: dict[str, DataFrame], text: str, parameters=None) -> DataFrame:
    """The rows of one SELECT over the given tables."""
    relations = Relations(spark)
    for name, rows in tables.items():
        relations.register(name, rows)
    return relations.frame(text, parameters)

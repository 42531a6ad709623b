"""Operators over cells: runs, ranges, lookups, pages, histograms, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError

#: Rows a chunk when runs are found; runs are joined across chunk borders afterwards.
CHUNK = 1 << 16


def containing(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains text in any case."""
    return rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 100:
        raise EngineError("a page needs an offset of at least 0 and a limit of 1 to 100")
    return rows.orderBy(*(F.asc_nulls_last(c) for c in order)).offset(offset).limit(limit)


def dense_rows(rows: DataFrame, row: str, first: int, last: int) -> DataFrame:
    """One row for every number from first to last; those without a row have nulls."""
    numbers = rows.sparkSession.range(first, last + 1).withColumnRenamed("id", row)
    return numbers.join(rows.where(F.col(row).between(first, last)), row, "left")


def lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Every wanted key with its row, or nulls."""
    return wanted.join(rows, keys, "left")


def runs(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys, first_row, last_row, n) of the maximal runs of consecutive numbers; numbers must be distinct for a key.

    Runs are found in chunks of rows, so one key may hold any number of rows; only the runs that touch a
    chunk's border, at most two a chunk, are then joined.
    """
    chunk = F.floor(F.col(row) / CHUNK)
    over = Window.partitionBy(*keys, "_chunk").orderBy(row)
    told = cells.select(*keys, F.col(row).cast("bigint").alias(row)).withColumn("_chunk", chunk)
    told = told.withColumn("_group", F.col(row) - F.row_number().over(over))
    short = told.groupBy(*keys, "_chunk", "_group").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("n")).drop("_group")
    at_border = (F.col("first_row") == F.col("_chunk") * CHUNK) | (F.col("last_row") == F.col("_chunk") * CHUNK + CHUNK - 1)
    inner, border = short.where(~at_border).drop("_chunk"), short.where(at_border)
    along = Window.partitionBy(*keys).orderBy("first_row")
    starts = F.coalesce((F.col("first_row") != F.lag("last_row").over(along) + 1).cast("int"), F.lit(1))
    border = border.withColumn("_start", starts).withColumn("_group", F.sum("_start").over(along))
    border = border.groupBy(*keys, "_group").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("n").alias("n")).drop("_group")
    return inner.unionByName(border)


def style_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("style").agg(F.count("*").alias("cells"))


def bounds(cells: DataFrame) -> DataFrame:
    """Of each sheet: non-empty cells, formulas and the rectangle that holds them."""
    return cells.groupBy("sheet").agg(F.count("*").alias("nonempty"), F.count("formula").alias("formulas"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def mismatches(actual: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual) where the actual value is not the expected one; an absent cell is null."""
    return wanted.join(actual, key, "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select(key, "expected", "actual")

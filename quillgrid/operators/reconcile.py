"""Reconciliation of two snapshots by a unique key.

One full outer join on the key finds what was added, removed or changed; values differ by IS DISTINCT
FROM, so nulls and exact decimals compare as values. Only key and compared columns are read.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total, null_keys (rows with a null in the key), distinct_keys."""
    null = None
    for k in keys:
        null = F.col(quoted(k)).isNull() if null is None else null | F.col(quoted(k)).isNull()
    # a struct counts tuples with nulls too, as a list of columns would not
    return rows.agg(F.count("*").alias("total"), F.count_if(null).alias("null_keys"), F.count_distinct(F.struct(*(F.col(quoted(k)) for k in keys))).alias("distinct_keys"))


def check_keys(rows: DataFrame, keys: list[str], side: str) -> int:
    """The number of rows; raises on null keys first, then on duplicate ones."""
    total, null, distinct = key_audit(rows, keys).first()
    if null:
        raise EngineError(f"{side}: {null} rows have a null key")
    if distinct != total:
        raise EngineError(f"{side}: {total - distinct} rows repeat a key")
    return total


def check_finite(rows: DataFrame, columns: list[str], side: str) -> None:
    """Raise if a compared or key column holds a double that is not finite."""
    doubles = [f.name for f in rows.schema.fields if f.name in columns and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if doubles:
        odd = None
        for c in doubles:
            x = F.col(quoted(c))
            here = F.isnan(x) | (F.abs(x) == float("inf"))
            odd = here if odd is None else odd | here
        if not rows.where(odd).isEmpty():
            raise EngineError(f"{side}: a value is not finite")


def changes(before: DataFrame, after: DataFrame, keys: list[str], compare: list[str], sheet: str) -> DataFrame:
    """(kind, before_sheet, after_sheet, k0.., b0.., a0..) of the keys that differ."""
    b = before.select(F.col(quoted(sheet)).alias("before_sheet"), *(F.col(quoted(k)).alias(f"p{i}") for i, k in enumerate(keys)), *(F.col(quoted(c)).alias(f"b{i}") for i, c in enumerate(compare)), F.lit(True).alias("has_before"))
    a = after.select(F.col(quoted(sheet)).alias("after_sheet"), *(F.col(quoted(k)).alias(f"q{i}") for i, k in enumerate(keys)), *(F.col(quoted(c)).alias(f"a{i}") for i, c in enumerate(compare)), F.lit(True).alias("has_after"))
    on = None
    for i in range(len(keys)):
        same = F.col(f"p{i}") == F.col(f"q{i}")
        on = same if on is None else on & same
    joined = b.join(a, on, "full_outer")
    differs = F.col("has_before").isNull() | F.col("has_after").isNull()
    for i in range(len(compare)):
        differs |= ~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))
    kind = F.when(F.col("has_before").isNull(), "added").when(F.col("has_after").isNull(), "removed").otherwise("changed")
    return joined.where(differs).select(kind.alias("kind"), "before_sheet", "after_sheet", *(F.coalesce(f"p{i}", f"q{i}").alias(f"k{i}") for i in range(len(keys))), *(f"b{i}" for i in range(len(compare))), *(f"a{i}" for i in range(len(compare))))


def counts(made: DataFrame, before: DataFrame) -> DataFrame:
    """One row: added, removed, changed, unchanged; a kind that is absent counts 0."""
    each = made.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")))
    total = before.agg(F.count("*").alias("total"))
    return each.crossJoin(total).select("added", "removed", "changed", (F.col("total") - F.col("removed") - F.col("changed")).alias("unchanged"))


def _differences(i: int) -> Column:
    return F.count_if((F.col("kind") == "changed") & ~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")))


def changed_columns(made: DataFrame, compare: list[str]) -> DataFrame:
    """(column_name, changed): in how many changed records each column differs; one aggregate for all columns."""
    one = made.agg(*(_differences(i).alias(f"n{i}") for i in range(len(compare))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(compare)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def ordered(made: DataFrame, keys: int) -> DataFrame:
    return made.orderBy(*(F.asc_nulls_last(f"k{i}") for i in range(keys)))


def sample(made: DataFrame, keys: int, limit: int) -> DataFrame:
    """The first changes in key order."""
    return ordered(made, keys).limit(limit)


def _text_of(column: Column, kind: T.DataType) -> Column:
    """Decimals, dates and timestamps go into JSON as text."""
    return column.cast("string") if isinstance(kind, (T.DecimalType, T.DateType, T.TimestampNTZType, T.TimestampType)) else column


def record(keys: list[str], compare: list[str], made: DataFrame) -> Column:
    """The JSON record of a change."""
    types = {f.name: f.dataType for f in made.schema.fields}
    pick = lambda names, prefix: F.struct(*(_text_of(F.col(f"{prefix}{i}"), types[f"{prefix}{i}"]).alias(n) for i, n in enumerate(names))) if names else F.from_json(F.lit("{}"), T.StructType([]))
    side = lambda absent, sheet, prefix: F.when(F.col("kind") != absent, F.struct(F.col(sheet).alias("sheet"), pick(compare, prefix).alias("values")))
    differing = [F.when((F.col("kind") == "changed") & ~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")), F.lit(c)) for i, c in enumerate(compare)]
    names = F.array_compact(F.array(*differing)) if compare else F.array().cast("array<string>")
    whole = F.struct(F.col("kind"), pick(keys, "k").alias("key"), side("added", "before_sheet", "b").alias("before"), side("removed", "after_sheet", "a").alias("after"), names.alias("changed_columns"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def export_jsonl(made: DataFrame, keys: list[str], compare: list[str], path: str | Path, overwrite: bool = False) -> int:
    """Write all changes in key order, one JSON record a line; the file appears whole or not at all."""
    path = Path(path)
    lines = ordered(made, len(keys)).select(record(keys, compare, made).alias("line"))
    handle, part = tempfile.mkstemp(prefix=f".{path.name}.", dir=path.parent)
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            for row in lines.toLocalIterator(prefetchPartitions=True):
                f.write(row.line + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(part, path)
        else:
            try:
                os.link(part, path)
            except FileExistsError as e:
                raise EngineError(f"{path} exists already") from e
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(part)
    return n


def export_table(made: DataFrame, keys: list[str], compare: list[str], path: str) -> None:
    """Write all changes as a folder of JSONL files in key order, by the executors: for results beyond one file."""
    ordered(made, len(keys)).select(record(keys, compare, made).alias("value")).write.text(path)

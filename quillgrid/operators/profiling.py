"""Column profiles in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reconcile import quoted

#: Columns a pass: each exact distinct count multiplies the rows that are aggregated.
GROUP = 8


def profile(rows: DataFrame) -> DataFrame:
    """(column_name, rows, nonnull, distinct_values, mean) of each column; mean is null unless it is numeric."""
    out = None
    fields = rows.schema.fields
    for lo in range(0, len(fields), GROUP):
        some = fields[lo : lo + GROUP]
        sums, parts = [F.count("*").alias("rows")], []
        for i, f in enumerate(some):
            c = F.col(quoted(f.name))
            sums += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}")]
            numeric = isinstance(f.dataType, T.NumericType)
            if numeric:
                total = F.sum(c.cast("decimal(38,6)") if isinstance(f.dataType, T.DecimalType) and f.dataType.scale <= 6 else c)
                sums.append((total.cast("double") / F.nullif(F.count(c), F.lit(0).cast("bigint")) if not isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.avg(c)).alias(f"m{i}"))
            mean = F.col(f"m{i}") if numeric else F.lit(None)
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("nonnull"), F.col(f"d{i}").alias("distinct_values"), mean.cast("double").alias("mean")))
        one = rows.agg(*sums).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
        out = one if out is None else out.union(one)
    return out

"""Declared column types and the conversion of cell text to them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

_DECIMAL = re.compile(r"DECIMAL\((\d{1,2}),(\d{1,2})\)")
_PLAIN = {"VARCHAR": T.StringType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType()}


def parse_type(name: str) -> T.DataType:
    """VARCHAR, DOUBLE, BIGINT, BOOLEAN, DATE, TIMESTAMP or DECIMAL(p,s), in any case."""
    upper = str(name).upper()
    if upper in _PLAIN:
        return _PLAIN[upper]
    m = _DECIMAL.fullmatch(upper)
    if not m or not 1 <= int(m[1]) <= 38 or int(m[2]) > int(m[1]):
        raise EngineError(f"unknown column type {name!r}")
    return T.DecimalType(int(m[1]), int(m[2]))


def from_text(text: Column, kind: T.DataType) -> Column:
    """Convert a column of text; text that does not fit raises when the plan runs, null stays null.

    Whole numbers may be written with a fraction or an exponent and round half away from zero;
    dates must be written yyyy-mm-dd, so that serial numbers are not taken for years.
    """
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.LongType):
        return F.round(text.cast("decimal(38,10)")).cast("bigint")
    if isinstance(kind, T.DateType):
        good = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$")
        return F.when(text.isNull() | good, text.cast("date")).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)))
    if isinstance(kind, T.TimestampNTZType):
        good = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}")
        return F.when(text.isNull() | good, text.cast("timestamp_ntz")).otherwise(F.raise_error(F.concat(F.lit("not a timestamp: "), text)))
    return text.cast(kind)

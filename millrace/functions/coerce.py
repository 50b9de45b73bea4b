"""Coercions at sinks: lax casts to the type that a first record fixed, and text for CSV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python types that a first value can fix, and the Spark type of the column.
SPARK_TYPE = {bool: "boolean", int: "long", float: "double", str: "string"}


def compat_cast(c: Column, kind: T.DataType, target: str) -> Column:
    """c as target: boolean (text "true" in any case or "1" is true, other text false), long or double (numbers, or text that parses, else null), string (text of the value)."""
    text = isinstance(kind, T.StringType)
    if target == "boolean":
        if isinstance(kind, T.BooleanType):
            return c
        return F.when(c.isNotNull(), (F.lower(c) == "true") | (c == "1")) if text else F.lit(None).cast("boolean")
    if target == "long":
        if text:
            return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
        return F.when(c == F.floor(c), c.try_cast("long")) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.try_cast("long")
    if target == "double":
        if text:
            return F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
        return c.try_cast("double")
    return c.cast("string")


def csv_text(c: Column, kind: T.DataType) -> Column:
    """A cell: null is empty, booleans are true or false, nested values are JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))

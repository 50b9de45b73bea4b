"""Lax conversion of one column to a Python scalar type, as column expressions.

Each conversion classifies a value: good (with its value), bad (with an error code), or
unsure, for forms whose reading is left to the validator itself: underscores, signs
after leading zeros, integers beyond 64 bits, and white space outside ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT = r"^[\x20\t\n\r\x0b\f]*[+-]?[0-9]+(\.0+)?[\x20\t\n\r\x0b\f]*$"
FLOAT = r"^[\x20\t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:nan|inf|infinity))[\x20\t\n\r\x0b\f]*$"
UNSURE_NUMBER = r"_|[^\x00-\x7f]|^[\x20\t\n\r\x0b\f]*[+-]?0+[+-]|[\x1c-\x1f]"
#: What counts as true and as false, in any case.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
INTEGERS, FLOATS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)


@dataclass
class Checked:
    """value (null unless good), code (error code of a bad value, else null), unsure (true, or false)."""

    value: Column
    code: Column
    unsure: Column


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x20\t\n\r\x0b\f]+|[\x20\t\n\r\x0b\f]+$", "")


def _to_int(c: Column, kind: T.DataType) -> Checked:
    no = F.lit(False)
    if isinstance(kind, T.StringType):
        digits = F.regexp_replace(_strip(c), r"\.0+$", "")
        value = F.when(c.rlike(INT), digits.try_cast("long"))
        unsure = c.rlike(UNSURE_NUMBER) | (c.rlike(INT) & value.isNull())
        return Checked(value, F.when(~c.rlike(INT), F.lit("int_parsing")), unsure)
    if isinstance(kind, FLOATS):
        whole = (c == F.floor(c)) & ~F.isnan(c) & (F.abs(c) < F.lit(9.2e18))
        far = (F.abs(c) >= F.lit(9.2e18)) & ~F.isnan(c)
        odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        code = F.when(odd, "finite_number").when(~whole & ~far, "int_from_float")
        return Checked(F.when(whole, c.try_cast("long")), code, far & ~odd)
    if isinstance(kind, INTEGERS) or isinstance(kind, T.BooleanType):
        return Checked(c.cast("long"), F.lit(None).cast("string"), no)
    if isinstance(kind, T.DecimalType):
        return Checked(F.when(c == F.floor(c), c.try_cast("long")), F.when(c != F.floor(c), "int_from_float"), no)
    return Checked(F.lit(None).cast("long"), F.lit("int_type"), no)


def _to_float(c: Column, kind: T.DataType) -> Checked:
    if isinstance(kind, T.StringType):
        low = F.lower(_strip(c))
        named = F.when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(low.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        return Checked(F.when(c.rlike(FLOAT), F.coalesce(named, low.try_cast("double"))), F.when(~c.rlike(FLOAT), "float_parsing"), c.rlike(UNSURE_NUMBER))
    if isinstance(kind, INTEGERS + FLOATS + (T.BooleanType, T.DecimalType)):
        return Checked(c.cast("double"), F.lit(None).cast("string"), F.lit(False))
    return Checked(F.lit(None).cast("double"), F.lit("float_type"), F.lit(False))


def _to_bool(c: Column, kind: T.DataType) -> Checked:
    no = F.lit(False)
    if isinstance(kind, T.BooleanType):
        return Checked(c, F.lit(None).cast("string"), no)
    if isinstance(kind, T.StringType):
        low = F.lower(c)
        value = F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))
        return Checked(value, F.when(value.isNull(), "bool_parsing"), c.rlike(r"[^\x00-\x7f]"))
    if isinstance(kind, INTEGERS + FLOATS):
        value = F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
        return Checked(value, F.when(value.isNull(), "bool_parsing" if isinstance(kind, INTEGERS) else "bool_type"), no)
    return Checked(F.lit(None).cast("boolean"), F.lit("bool_type"), no)


def _to_str(c: Column, kind: T.DataType) -> Checked:
    if isinstance(kind, T.StringType):
        return Checked(c, F.lit(None).cast("string"), F.lit(False))
    return Checked(F.lit(None).cast("string"), F.lit("string_type"), F.lit(False))


_BY_TYPE = {int: (_to_int, "int_type"), float: (_to_float, "float_type"), bool: (_to_bool, "bool_type"), str: (_to_str, "string_type")}


def convert(c: Column, kind: T.DataType, target: type) -> Checked:
    """c, of Spark type kind, to target (int, float, bool or str); null is bad."""
    function, null_code = _BY_TYPE[target]
    got = function(c, kind)
    code = F.when(c.isNull(), null_code).otherwise(got.code)
    return Checked(F.when(c.isNotNull(), got.value), code, F.coalesce(got.unsure, F.lit(False)))

"""Validation by a Pydantic model, compiled to column expressions where the model allows.

Fields of int, float, bool, str, Optional, Literal and Enum, bounds, lengths, patterns of
a simple form, defaults, and extra fields ignored or forbidden become expressions. A
value whose reading isn't certain sends its record, and any other model all records,
through the model itself, in Arrow batches. A record fails or passes by itself: others
in its batch have no influence.
"""

from __future__ import annotations

import enum
import re
import types
import typing
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pydantic import BaseModel, TypeAdapter, ValidationError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.convert import convert
from millrace.model import ERR, ERRORS, RAW, STATUS, VALID, Status

SCALARS = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType()}
#: Patterns with one meaning to both engines: literals, classes, groups, counts, and both ends.
SIMPLE_PATTERN = re.compile(r"^\^?([\w \-@#%&=:;,<>!~/]|\\[.dDwWsS\-/]|\.|\[\^?[\w \-@.+%#/]+\]|\(|\)|\||[*+?]|\{[0-9]+(,[0-9]*)?\})*\$?$")
MESSAGES = {
    "missing": "Field required",
    "int_parsing": "Input should be a valid integer, unable to parse string as an integer",
    "int_from_float": "Input should be a valid integer, got a number with a fractional part",
    "int_type": "Input should be a valid integer",
    "finite_number": "Input should be a finite number",
    "float_parsing": "Input should be a valid number, unable to parse string as a number",
    "float_type": "Input should be a valid number",
    "bool_parsing": "Input should be a valid boolean, unable to interpret input",
    "bool_type": "Input should be a valid boolean",
    "string_type": "Input should be a valid string",
    "extra_forbidden": "Extra inputs are not permitted",
}


@dataclass
class Field:
    name: str
    target: type
    optional: bool
    choices: list | None
    checks: list[tuple[str, object]]
    required: bool
    default: object


def _unwrap(annotation) -> tuple[object, bool]:
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(inner) == 1 and len(typing.get_args(annotation)) == 2:
            return inner[0], True
    return annotation, False


CHECKS = {"ge": "greater_than_equal", "gt": "greater_than", "le": "less_than_equal", "lt": "less_than", "multiple_of": "multiple_of", "min_length": "string_too_short", "max_length": "string_too_long", "pattern": "string_pattern_mismatch"}


def compile_field(name: str, info) -> Field | None:
    """The field if it can be lowered, else None."""
    annotation, optional = _unwrap(info.annotation)
    if info.alias is not None or info.validation_alias is not None or info.discriminator is not None or info.default_factory is not None:
        return None
    choices, target = None, annotation
    if typing.get_origin(annotation) is typing.Literal:
        choices = list(typing.get_args(annotation))
        if not all(type(c) is str for c in choices):
            return None
        target = str
    elif isinstance(annotation, type) and issubclass(annotation, enum.Enum):
        choices = [c.value for c in annotation]
        if not all(type(c) is str for c in choices):
            return None
        target = str
    if target not in SCALARS:
        return None
    checks: list[tuple[str, object]] = []
    for m in info.metadata:
        known = [(k, getattr(m, k)) for k in CHECKS if getattr(m, k, None) is not None]
        if not known or getattr(m, "strict", None):
            return None
        checks += known
    for k, v in checks:
        if k == "pattern" and not (isinstance(v, str) and SIMPLE_PATTERN.match(v)):
            return None
        if k in ("min_length", "max_length", "pattern") and target is not str:
            return None
    default = None if info.is_required() else info.default
    if isinstance(default, enum.Enum):
        default = default.value
    if default is not None and not isinstance(default, (int, float, bool, str)):
        return None
    return Field(name, target, optional, choices, checks, info.is_required(), default)


def _compile(model: type[BaseModel]) -> list[Field] | None:
    decorators = model.__pydantic_decorators__
    custom = any(getattr(decorators, k, None) for k in ("field_validators", "model_validators", "validators", "root_validators", "computed_fields", "field_serializers", "model_serializers"))
    config = model.model_config
    odd = config.get("extra", "ignore") == "allow" or any(config.get(k) for k in ("strict", "str_strip_whitespace", "str_to_lower", "str_to_upper", "str_min_length", "str_max_length", "coerce_numbers_to_str", "alias_generator"))
    if custom or odd:
        return None
    fields = [compile_field(n, i) for n, i in model.model_fields.items()]
    return None if any(f is None for f in fields) else fields


def spark_type(annotation) -> T.DataType:
    """The Spark type of what a model's dump holds for the annotation; text where there is no closer one."""
    annotation, _ = _unwrap(annotation)
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if annotation in SCALARS:
        return SCALARS[annotation]
    if origin in (list, set, tuple, frozenset) and args:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict and len(args) == 2:
        return T.MapType(T.StringType(), spark_type(args[1]))
    if isinstance(annotation, type) and issubclass(annotation, BaseModel):
        return model_schema(annotation)
    import datetime

    return {datetime.date: T.DateType(), datetime.datetime: T.TimestampType()}.get(annotation, T.StringType())


def model_schema(model: type[BaseModel]) -> T.StructType:
    return T.StructType([T.StructField(n, spark_type(i.annotation)) for n, i in model.model_fields.items()])


def _error(code: str, loc: str, msg: str | None = None) -> Column:
    return F.struct(F.lit(msg or MESSAGES.get(code, code)).alias("msg"), F.lit(code).alias("type"), F.array(F.lit(loc)).alias("loc"))


class Validator:
    """Adds the validated data, status and errors to enveloped records."""

    def __init__(self, model: type[BaseModel], *, native: bool = True):
        self.model = model
        self.fields = _compile(model) if native else None
        self.schema = model_schema(model)

    @property
    def native(self) -> bool:
        return self.fields is not None

    def required_columns(self) -> list[str] | None:
        """The raw columns that the model can see, or None if it may look at all of them."""
        config = self.model.model_config
        if config.get("extra", "ignore") != "ignore" or config.get("alias_generator") or any(i.alias or i.validation_alias for i in self.model.model_fields.values()):
            return None
        if getattr(self.model.__pydantic_decorators__, "model_validators", None):
            return None
        return list(self.model.model_fields)

    def apply(self, df: DataFrame, *, once: bool = False) -> DataFrame:
        """df with validated data, status and errors.

        once: rows are computed a single time, for plans whose rows may come out differently
        when they are computed again; they all pass through Arrow then if any may be unsure.
        """
        if not self.native:
            return self._by_model(df)
        checked = self._by_columns(df)
        if once and self._may_be_unsure(df):
            return self._by_model(checked, only="__unsure")
        sure = checked.filter(~F.col("__unsure")).drop("__unsure")
        if not self._may_be_unsure(df):
            return sure
        unsure = checked.filter("__unsure").drop("__unsure", VALID)
        return sure.unionByName(self._by_model(unsure.withColumn(STATUS, F.lit(Status.PENDING.value)).withColumn(ERR, F.array().cast(ERRORS))))

    def _may_be_unsure(self, df: DataFrame) -> bool:
        kinds = {f.name: f.dataType for f in df.schema[RAW].dataType.fields}
        return any(not isinstance(kinds.get(f.name), (*map(type, SCALARS.values()), T.IntegerType)) or (f.target is not str and isinstance(kinds[f.name], T.StringType)) or (f.target is int and isinstance(kinds[f.name], T.DoubleType)) for f in self.fields if f.name in kinds)

    def _by_columns(self, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema[RAW].dataType.fields}
        values, errors, unsure = [], [], [F.lit(False)]
        none = F.lit(None).cast("struct<msg:string,type:string,loc:array<string>>")
        for f in self.fields:
            kind = SCALARS[f.target]
            if f.name not in kinds:
                values.append(F.lit(f.default).cast(kind).alias(f.name))
                if f.required:
                    errors.append(_error("missing", f.name))
                continue
            raw = F.col(f"{RAW}.`{f.name}`")
            if isinstance(kinds[f.name], T.NullType):
                raw = raw.cast(kind)
            got = convert(raw, kinds[f.name] if not isinstance(kinds[f.name], T.NullType) else kind, f.target)
            value, code = got.value, got.code
            if f.choices is not None:
                code = F.when(raw.isNull() | ~raw.cast("string").isin(*f.choices), "literal_error" if not self._is_enum(f.name) else "enum")
            problem = reduce(lambda p, c: p.when(code == c, _error(c, f.name)), [*MESSAGES, "literal_error", "enum"], F.when(code.isNull(), none))
            for check, limit in f.checks:
                bad = self._breaks(value, check, limit, f.target)
                problem = F.when(code.isNull() & bad, _error(CHECKS[check], f.name, f"Input should satisfy {check} {limit}")).otherwise(problem)
            if f.optional:
                problem = F.when(raw.isNull(), none).otherwise(problem)
            errors.append(problem)
            unsure.append(F.coalesce(got.unsure, F.lit(False)) if f.choices is None else F.lit(False))
            values.append(value.alias(f.name))
        if self.model.model_config.get("extra") == "forbid":
            errors += [_error("extra_forbidden", k) for k in kinds if k not in {f.name for f in self.fields}]
        found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast(ERRORS)
        out = df.withColumn("__found", found).withColumn("__unsure", reduce(lambda a, b: a | b, unsure))
        bad = F.size("__found") > 0
        data = F.when(~bad, F.struct(*values)) if values else F.when(~bad, F.struct(F.lit(None).alias("_")))
        out = out.withColumn(VALID, data).withColumn(STATUS, F.when(bad, Status.FAILED.value).otherwise(Status.VALIDATED.value))
        return out.withColumn(ERR, F.concat(ERR, F.col("__found").cast(ERRORS))).drop("__found")

    def _is_enum(self, name: str) -> bool:
        annotation, _ = _unwrap(self.model.model_fields[name].annotation)
        return isinstance(annotation, type) and issubclass(annotation, enum.Enum)

    @staticmethod
    def _breaks(value: Column, check: str, limit, target: type) -> Column:
        if check in ("min_length", "max_length"):
            return F.length(value) < limit if check == "min_length" else F.length(value) > limit
        if check == "pattern":
            return ~value.rlike(limit)
        if check == "multiple_of":
            return value % F.lit(limit) != 0
        # Spark takes NaN for greater than any number; the model takes no comparison with it for true.
        nan = F.isnan(value) if target is float else F.lit(False)
        return nan | ~{"ge": value >= limit, "gt": value > limit, "le": value <= limit, "lt": value < limit}[check]

    def _by_model(self, df: DataFrame, only: str | None = None) -> DataFrame:
        """only: a column that says which rows the model itself is to read; the others keep what they have."""
        from pyspark.sql.pandas.types import to_arrow_schema

        model = self.model
        kept = [f for f in df.schema.fields if f.name not in (VALID, only)]
        schema = T.StructType([*kept, T.StructField(VALID, self.schema)])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            adapter = TypeAdapter(model)
            for batch in batches:
                rows = batch.to_pylist(maps_as_pydicts="strict")
                for row in rows:
                    if only is not None:
                        if not row[only]:
                            continue
                        row[ERR] = []
                    try:
                        row[VALID] = _dumped(adapter.validate_python(row[RAW]).model_dump(mode="python"))
                        row[STATUS] = Status.VALIDATED.value
                    except OverflowError as e:  # the model takes integers of any size, a column those of 64 bits
                        row[VALID], row[STATUS] = None, Status.FAILED.value
                        row[ERR] = [*(row[ERR] or []), {"msg": str(e), "type": "int_out_of_range", "loc": []}]
                    except ValidationError as e:
                        row[VALID], row[STATUS] = None, Status.FAILED.value
                        row[ERR] = [*(row[ERR] or []), *({"msg": x["msg"], "type": x["type"], "loc": [str(p) for p in x["loc"]]} for x in e.errors())]
                yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema.fields} for r in rows], schema=arrow)

        return df.select([*(f.name for f in kept), *([VALID, only] if only else [])]).mapInArrow(run, schema)


def _dumped(value):
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        raise OverflowError("Input should be an integer of 64 bits")
    if isinstance(value, enum.Enum):
        return value.value
    if isinstance(value, dict):
        return {k: _dumped(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_dumped(v) for v in value]
    return value

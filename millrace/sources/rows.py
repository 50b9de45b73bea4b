"""Python iterables and DataFrames as sources."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import ConfigError
from millrace.sources.base import Source


class RowsSource(Source):
    """An iterable of dicts (or other objects, as field `value`), taken chunk by chunk.

    Unless a schema is given, the fields are those of all records, in the order in which
    they first appear; a field with numbers of several kinds holds doubles, and one with
    other mixtures text. Fields that a record lacks are null.
    """

    can_split = False

    def __init__(self, rows: Iterable, schema: T.StructType | str | None = None, chunk: int = 10_000, **more):
        super().__init__(**more)
        self.rows, self.schema, self.chunk = rows, schema, chunk

    def read(self, spark: SparkSession) -> DataFrame:
        rows = iter(self.rows)
        parts = []
        while block := [r if isinstance(r, dict) else {"value": r} for r in islice(rows, self.chunk)]:
            if self.schema is not None:
                parts.append(spark.createDataFrame(block, self.schema))
                continue
            names = list(dict.fromkeys(k for r in block for k in r))
            kinds = {k: _kind([r.get(k) for r in block]) for k in names}
            fields = T.StructType([T.StructField(k, kinds[k] or T.StringType()) for k in names])
            convert = {k: str if isinstance(kinds[k], T.StringType) else float if isinstance(kinds[k], T.DoubleType) else _same for k in names}
            full = [tuple(None if r.get(k) is None else convert[k](r[k]) for k in names) for r in block]
            parts.append((spark.createDataFrame(full, fields), kinds))
        if not parts:
            return spark.createDataFrame([], self.schema or T.StructType())
        if self.schema is None:
            known: dict[str, T.DataType | None] = {}
            for _, kinds in parts:
                for k, kind in kinds.items():
                    known[k] = _merged(known.get(k), kind)
            final = {k: kind or T.StringType() for k, kind in known.items()}
            parts = [p.select(*[(F.col(f"`{k}`") if k in p.columns else F.lit(None)).cast(kind).alias(k) for k, kind in final.items()]) for p, _ in parts]
        while len(parts) > 1:  # a tree, whose depth grows with the logarithm of the number of chunks
            parts = [a[0].unionByName(a[1]) if len(a) > 1 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
        return parts[0]


def _same(value):
    return value


def _kind(values: list) -> T.DataType | None:
    """The type that holds all values; None if all are null."""
    from pyspark.sql.types import _infer_type

    kind = None
    for v in values:
        if v is not None:
            kind = _merged(kind, T.DoubleType() if type(v) is float else T.LongType() if type(v) is int else _infer_type(v))
    return kind


def _merged(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    if a is None or b is None or a == b:
        return a if b is None else b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if {type(a), type(b)} <= {T.StructType, T.ArrayType, T.MapType} and type(a) is type(b):
        from pyspark.sql.types import _merge_type

        return _merge_type(a, b)
    return T.StringType()


class FrameSource(Source):
    """A DataFrame that is there already."""

    def __init__(self, df: DataFrame, **more):
        super().__init__(**more)
        self.df = df

    def read(self, spark: SparkSession) -> DataFrame:
        return self.df


class BytesSource(Source):
    """CSV or JSON text that is in memory already; kind: "csv" or "json", options as of the file's source."""

    can_split = False

    def __init__(self, data: bytes, kind: str, limit: int | None = None, **options):
        super().__init__(limit=limit)
        self.data, self.kind, self.options = data, kind, options

    def read(self, spark: SparkSession) -> DataFrame:
        from millrace.sources.files import json_values

        text = self.data.decode("utf-8")
        if self.kind == "json":
            rows = spark.createDataFrame([(v,) for v in json_values(text)], "value string")
            reader = spark.read.option("mode", "FAILFAST")
            reader = reader.schema(self.options["schema"]) if "schema" in self.options else reader
            return reader.json(rows.rdd.map(lambda r: r[0]))
        import csv
        import io

        records = list(csv.reader(io.StringIO(text), delimiter=self.options.get("delimiter", ","), quotechar=self.options.get("quotechar", '"')))
        names = self.options.get("fieldnames") or (records.pop(0) if records else [])
        if any(len(r) != len(names) for r in records):
            raise ConfigError("CSV parse error: a row of another length")
        return spark.createDataFrame(records, T.StructType([T.StructField(n, T.StringType()) for n in names]))

"""Files: CSV, JSON, Parquet, Arrow IPC and Excel workbooks."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.coerce import csv_text
from millrace.model import ConfigError
from millrace.sinks.base import Sink, local, make_parent, remove, write_single
from millrace.sources import xlsx


def codec(path: str) -> str | None:
    return {"gz": "gzip", "zst": "zstd"}.get(path.rpartition(".")[2])


class CsvSink(Sink):
    """Text with a header; null is an empty cell, booleans are true and false. Spaces and breaks at the edges of a cell stay."""

    def __init__(self, path: str, delimiter: str = ",", quotechar: str = '"', fieldnames: list[str] | None = None, **more):
        super().__init__(path, fieldnames=fieldnames, **more)
        self.delimiter, self.quotechar = delimiter, quotechar

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        text = df.select(*[csv_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
        options = {"header": True, "sep": self.delimiter, "quote": self.quotechar, "escape": self.quotechar, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        options |= {"compression": c} if (c := codec(self.path)) else {}
        if self.single:
            write_single(text, self.path, "csv", options)
        else:
            text.write.mode("overwrite").options(**options).csv(self.path)
        return {"path": self.path}


class JsonSink(Sink):
    """format "jsonl": a record a line; "array": one array, indented on request, which the driver streams to one file."""

    def __init__(self, path: str, format: str = "array", indent: int | None = None, **more):
        super().__init__(path, **more)
        if format not in ("array", "jsonl"):
            raise ConfigError(f"unknown JSON format {format}")
        self.format, self.indent, self.observes = format, indent, format == "jsonl"

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        options = {"ignoreNullFields": False} | ({"compression": c} if (c := codec(self.path)) else {})
        if self.format == "jsonl":
            if self.single:
                write_single(df, self.path, "json", options)
            else:
                df.write.mode("overwrite").options(**options).json(self.path)
            return {"path": self.path}
        make_parent(self.path)
        beside = f"{local(self.path)}.{uuid.uuid4().hex}"
        with _open_text(beside, codec(self.path)) as out:
            first = True
            out.write("[")
            for (text,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=True):
                if self.indent is not None:
                    text = "\n" + "\n".join(" " * self.indent + x for x in json.dumps(json.loads(text), indent=self.indent, ensure_ascii=False).splitlines())
                out.write(("" if first else ",") + text)
                first = False
            out.write("\n]" if self.indent is not None and not first else "]")
        os.replace(beside, local(self.path))
        return {"path": self.path}


def _open_text(path: str, how: str | None):
    if how == "gzip":
        return gzip.open(path, "wt", encoding="utf-8")
    if how == "zstd":
        import zstandard

        return zstandard.open(path, "wt", encoding="utf-8")
    return open(path, "w", encoding="utf-8")


class ParquetSink(Sink):
    """Spark's own types and compression."""

    def __init__(self, path: str, single: bool = False, partition_by: list[str] | None = None, mode: str = "overwrite", **more):
        super().__init__(path, single=single, **more)
        self.partition_by, self.mode = partition_by, mode

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        if self.single:
            write_single(df, self.path, "parquet", {})
        else:
            writer = df.write.mode(self.mode)
            (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)
        return {"path": self.path}


class ArrowSink(Sink):
    """Arrow IPC files. Parts are written under names of their own and kept only if their task ended."""

    def __init__(self, path: str, single: bool = True, **more):
        super().__init__(path, single=single, **more)

    def write(self, df: DataFrame) -> dict:
        from pyspark.sql.pandas.types import to_arrow_schema

        df = self.chosen(df)
        schema, single = to_arrow_schema(df.schema), self.single
        target = local(self.path)
        beside = f"{target}.{uuid.uuid4().hex}"
        os.makedirs(beside, exist_ok=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = f"part-{uuid.uuid4().hex}.arrow"
            n = 0
            with pa.ipc.new_file(os.path.join(beside, name), schema) as out:
                for batch in batches:
                    out.write_batch(batch.cast(schema))
                    n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["name", "rows"])

        source = df.coalesce(1) if single else df
        done = source.mapInArrow(run, "name string, rows long").collect()  # a row per file
        if single:
            make_parent(self.path)
            if done:
                os.replace(os.path.join(beside, done[0][0]), target)
            else:
                with pa.ipc.new_file(target, schema):
                    pass
            remove(beside)
        else:
            for extra in set(os.listdir(beside)) - {d[0] for d in done}:
                os.remove(os.path.join(beside, extra))
            remove(target)
            os.replace(beside, target)
        return {"path": self.path, "rows": sum(d[1] for d in done)}


class ExcelSink(Sink):
    """One sheet with a bold header; the driver streams the rows. A sheet holds 1,048,576 rows at most."""

    can_split = observes = False

    def __init__(self, path: str, sheet_name: str = "Sheet1", fieldnames: list[str] | None = None, **more):
        super().__init__(path, fieldnames=fieldnames, **more)
        self.sheet_name = sheet_name

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        make_parent(self.path)
        beside = f"{local(self.path)}.{uuid.uuid4().hex}"
        simple = df.select(*[F.col(f"`{n}`") if t in ("string", "boolean", "double", "float", "int", "bigint", "smallint", "tinyint") else F.col(f"`{n}`").cast("string") for n, t in df.dtypes])

        def rows():
            yield df.columns
            for r in simple.toLocalIterator(prefetchPartitions=True):
                yield list(r)

        n = xlsx.write_sheet(beside, rows(), self.sheet_name)
        os.replace(beside, local(self.path))
        return {"path": self.path, "rows": n - 1}

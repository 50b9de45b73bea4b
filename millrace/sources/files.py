"""Files: CSV, JSON, Parquet, Arrow IPC and Excel workbooks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.model import ConfigError
from millrace.sources import xlsx
from millrace.sources.base import Source


class CsvSource(Source):
    """Text cells only; an empty cell is an empty text. A row of another length fails the pipe.

    skip_rows lines before the header are passed over; with fieldnames the first line is
    data unless has_header says otherwise. Files ending in .gz or .zst are unpacked.

    Quoted cells may have line breaks. Files without such cells are split among tasks, and
    with them each file is one task's; multiline says which it is, and None has Spark look
    for a line that opens a quote and doesn't close it. Not with skip_rows.
    """

    def __init__(
        self,
        path: str,
        delimiter: str = ",",
        quotechar: str = '"',
        skip_rows: int = 0,
        fieldnames: list[str] | None = None,
        has_header: bool | None = None,
        multiline: bool | None = None,
        **more,
    ):
        super().__init__(**more)
        self.multiline = multiline
        self.path, self.delimiter, self.quotechar, self.skip_rows, self.fieldnames = path, delimiter, quotechar, skip_rows, fieldnames
        self.has_header = fieldnames is None if has_header is None else has_header

    def _reader(self, spark: SparkSession):
        return spark.read.option("sep", self.delimiter).option("quote", self.quotechar).option("escape", self.quotechar).option("mode", "FAILFAST")

    def breaks(self, spark: SparkSession) -> bool:
        """Whether some cell has a line break, which leaves an odd number of quotes in its lines."""
        if self.multiline is not None:
            return self.multiline
        value = F.col("value")
        quotes = F.length(value) - F.length(F.replace(value, F.lit(self.quotechar), F.lit("")))
        return bool(spark.read.text(self.path).filter(F.contains(value, F.lit(self.quotechar)) & (quotes % 2 == 1)).head(1))

    def headers(self, spark: SparkSession) -> list[str]:
        if self.fieldnames:
            return self.fieldnames
        first = spark.read.text(self.path).head(self.skip_rows + 1)
        if len(first) <= self.skip_rows:
            return []
        line = spark.createDataFrame([(first[self.skip_rows][0],)], "value string")
        return [str(c) for c in self._reader(spark).csv(line.rdd.map(lambda r: r[0])).first()]

    def read(self, spark: SparkSession) -> DataFrame:
        names = self.headers(spark)
        if not names:
            return spark.createDataFrame([], T.StructType())
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if self.skip_rows:
            skip = self.skip_rows + self.has_header
            lines = spark.read.text(self.path).rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: x[1] >= skip).keys()
            df = self._reader(spark).schema(schema).csv(lines)
        else:
            df = self._reader(spark).option("multiLine", self.breaks(spark)).option("header", self.has_header).option("enforceSchema", True).schema(schema).csv(self.path)
        return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


class JsonSource(Source):
    """JSON values: lines (.jsonl, .ndjson), or any mix of arrays and values one after the other; arrays give their elements.

    Lines are split by Spark; other files are read whole, one task each. Values that are
    no objects are records with one field, value.
    """

    def __init__(self, path: str, lines: bool | None = None, schema: T.StructType | str | None = None, **more):
        super().__init__(**more)
        stem = path.removesuffix(".gz").removesuffix(".zst")
        self.path, self.schema = path, schema
        self.lines = stem.endswith((".jsonl", ".ndjson")) if lines is None else lines
        self.can_split = self.lines

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("mode", "FAILFAST")
        reader = reader.schema(self.schema) if self.schema is not None else reader
        if self.lines:
            return reader.json(self.path)
        texts = spark.read.text(self.path, wholetext=True).mapInArrow(_json_values, "value string")
        return reader.json(texts.rdd.map(lambda r: r[0]))


def json_values(text: str) -> Iterator[str]:
    """Each record of text as JSON text."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at == len(text):
            return
        value, at = decoder.raw_decode(text, at)
        for item in value if isinstance(value, list) else [value]:
            yield json.dumps(item if isinstance(item, dict) else {"value": item}, ensure_ascii=False)


def _json_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(list(json_values(text.as_py())), pa.string())], names=["value"])


class ParquetSource(Source):
    """All of Spark's types; filters and column choices reach the scan.

    row_groups picks groups of a single file by number, as ranges of the row index.
    """

    def __init__(self, path: str | list[str], row_groups: list[int] | None = None, **more):
        super().__init__(**more)
        self.paths = [path] if isinstance(path, str) else list(path)
        self.row_groups = row_groups

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(*self.paths)
        if self.row_groups is None:
            return df
        if len(self.paths) != 1:
            raise ConfigError("row groups can be chosen of a single file only")
        ends = list(accumulate(row_group_rows(self.paths[0])))
        starts = [0, *ends][: len(ends)]
        runs: list[tuple[int, int]] = []
        for start, end in sorted({(starts[g], ends[g]) for g in self.row_groups}):
            if runs and runs[-1][1] == start:
                runs[-1] = (runs[-1][0], end)
            else:
                runs.append((start, end))
        return df.filter(_within(F.col("_metadata.row_index"), runs))

    def split(self, workers: int) -> list[Source]:
        """Runs of row groups next to each other, the remainder to the last; at most one part for each group."""
        if len(self.paths) != 1:
            return [self]
        groups = self.row_groups if self.row_groups is not None else list(range(len(row_group_rows(self.paths[0]))))
        workers = max(1, min(workers, len(groups)))
        each = len(groups) // workers
        cuts = [i * each for i in range(workers)] + [len(groups)]
        return [ParquetSource(self.paths[0], groups[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _within(index: Column, runs: list[tuple[int, int]]) -> Column:
    """Whether index is in one of the runs, which are in order: a search tree, whose depth is the logarithm of their number."""
    if len(runs) < 2:
        return (index >= runs[0][0]) & (index < runs[0][1]) if runs else F.lit(False)
    half = len(runs) // 2
    return F.when(index < runs[half][0], _within(index, runs[:half])).otherwise(_within(index, runs[half:]))


def row_group_rows(path: str) -> list[int]:
    """Rows of each row group, from the footer."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path.removeprefix("file://"))
    return [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArrowFiles(DataSource):
    """Arrow IPC files, in partitions of record batches next to each other."""

    @classmethod
    def name(cls) -> str:
        return "millrace_arrow"

    def _files(self) -> list[str]:
        import os

        path = self.options["path"].removeprefix("file://")
        if os.path.isdir(path):
            return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".arrow", ".ipc", ".feather")))
        return [path]

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(pa.ipc.open_file(self._files()[0]).schema)

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(self._files(), [f.name for f in schema.fields], int(self.options.get("batches", 16)))


class _ArrowReader(DataSourceReader):
    def __init__(self, files: list[str], names: list[str], step: int):
        self.files, self.names, self.step = files, names, step

    def partitions(self) -> list[_Part]:
        return [_Part(f, i, i + self.step) for f in self.files for i in range(0, max(1, pa.ipc.open_file(f).num_record_batches), self.step)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.path) as file:
            reader = pa.ipc.open_file(file)
            for i in range(partition.start, min(partition.end, reader.num_record_batches)):
                yield reader.get_batch(i).select(self.names)


class ArrowSource(Source):
    """An Arrow IPC file, or a folder of them."""

    def __init__(self, path: str, **more):
        super().__init__(**more)
        self.path = path

    def read(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(ArrowFiles)
        return spark.read.format("millrace_arrow").load(self.path)


class ExcelSource(Source):
    """A sheet of an xlsx workbook, by name or number (the first if none is given).

    The header is row skip_rows unless fieldnames are given. Numbers are doubles, dates
    text; a column of mixed kinds is text. A sheet is one task's.
    """

    can_split = False

    def __init__(self, path: str, sheet: str | int | None = None, skip_rows: int = 0, fieldnames: list[str] | None = None, **more):
        super().__init__(**more)
        self.path, self.sheet, self.skip_rows, self.fieldnames = path, sheet, skip_rows, fieldnames

    def read(self, spark: SparkSession) -> DataFrame:
        rows = list(xlsx.read_sheet(self.path.removeprefix("file://"), self.sheet))[self.skip_rows :]
        names = self.fieldnames or ([str(c) for c in rows[0]] if rows else [])
        data = rows if self.fieldnames else rows[1:]
        kinds = []
        for i in range(len(names)):
            seen = {type(r[i]) for r in data if i < len(r) and r[i] is not None}
            kinds.append({frozenset({float}): "double", frozenset({bool}): "boolean"}.get(frozenset(seen), "string"))
        text = lambda v: v if v is None or isinstance(v, str) else xlsx.as_text(v)
        full = [tuple((text(r[i]) if kinds[i] == "string" else r[i]) if i < len(r) else None for i in range(len(names))) for r in data]
        return spark.createDataFrame(full, T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))) if names else spark.createDataFrame([], T.StructType())

    def sheets(self) -> list[str]:
        return xlsx.sheet_names(self.path.removeprefix("file://"))

"""SQL as a source: text handed to Spark, to a database by JDBC, or to SQLite; and ranges of keys."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.model import ConfigError
from millrace.sources.base import Source


class SqliteTable(DataSource):
    """A query or table of a SQLite file; a table is split by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "millrace_sqlite"

    def schema(self) -> T.StructType:
        o = self.options
        with sqlite3.connect(o["path"]) as db:
            of = f"({o['query']})" if "query" in o else f'"{o["table"]}"'
            names = [d[0] for d in db.execute(f"SELECT * FROM {of} LIMIT 0").description]
            # A column of SQLite may hold values of any type, so all of them are asked.
            quoted = ['"' + n.replace('"', '""') + '"' for n in names]
            kinds = db.execute(f"SELECT {', '.join(f'group_concat(DISTINCT typeof({q}))' for q in quoted)} FROM {of}").fetchone()
        return T.StructType([T.StructField(n, _kind(set((k or "").split(",")) - {"", "null"})) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


def _kind(seen: set[str]) -> T.DataType:
    if seen == {"integer"}:
        return T.LongType()
    if seen and seen <= {"integer", "real"}:
        return T.DoubleType()
    return T.BinaryType() if seen == {"blob"} else T.StringType()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[_Range]:
        parts = int(self.options.get("partitions", 4))
        if "query" in self.options or parts < 2:
            return [_Range(None, None)]
        try:
            with sqlite3.connect(self.options["path"]) as db:
                low, high = db.execute(f'SELECT MIN(rowid), MAX(rowid) FROM "{self.options["table"]}"').fetchone()
        except sqlite3.OperationalError:  # a view, or a table without rowid
            return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        o, cast = self.options, [{T.LongType: int, T.DoubleType: float, T.StringType: str}.get(type(f.dataType), lambda v: v) for f in self.schema.fields]
        text = o["query"] if "query" in o else f'SELECT * FROM "{o["table"]}"'
        if partition.low is not None:
            text += f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        with sqlite3.connect(o["path"]) as db:
            for row in db.execute(text):
                yield tuple(None if v is None else c(v) for c, v in zip(cast, row, strict=True))


class SqlSource(Source):
    """Exactly one of query and table_name, at a uri: spark: (views and tables of the session), sqlite:path, or jdbc:...

    The text of a query is passed on as it is.
    """

    def __init__(self, uri: str, query: str | None = None, table_name: str | None = None, options: dict[str, str] | None = None, **more):
        super().__init__(**more)
        if (query is None) == (table_name is None):
            raise ConfigError("give either a query or a table name")
        self.uri, self.query, self.table_name, self.options = uri, query, table_name, options or {}

    def read(self, spark: SparkSession) -> DataFrame:
        if self.uri.startswith("spark:"):
            return spark.sql(self.query) if self.query else spark.table(self.table_name)
        if self.uri.startswith("sqlite:"):
            spark.dataSource.register(SqliteTable)
            reader = spark.read.format("millrace_sqlite").options(**self.options).option("path", sqlite_path(self.uri))
            return (reader.option("query", self.query) if self.query else reader.option("table", self.table_name)).load()
        if self.uri.startswith("jdbc:"):
            reader = spark.read.format("jdbc").options(**self.options).option("url", self.uri)
            return (reader.option("query", self.query) if self.query else reader.option("dbtable", self.table_name)).load()
        raise ConfigError(f"no SQL source for {self.uri}")


def sqlite_path(uri: str) -> str:
    return re.sub(r"\?.*$", "", re.sub(r"^sqlite:(//)?", "", uri))


class PagedSqlSource(Source):
    """The rows of a table by ranges of an integer key, chunk_size ids each.

    By JDBC, Spark reads the ranges in tasks of their own; other tables are joined with
    the ranges. A range's rows are known to lie in it, so the join is by block of ids.
    """

    def __init__(self, uri: str, table_name: str, id_column: str, chunk_size: int, options: dict[str, str] | None = None, **more):
        super().__init__(**more)
        self.uri, self.table_name, self.id_column, self.chunk_size, self.options = uri, table_name, id_column, chunk_size, options or {}

    def anchors(self, spark: SparkSession) -> DataFrame:
        from millrace.operators.expand import page_anchors

        return page_anchors(SqlSource(self.uri, table_name=self.table_name, options=self.options).frame(spark), self.id_column, self.chunk_size)

    def read(self, spark: SparkSession) -> DataFrame:
        from millrace.operators.expand import expand_ranges

        if self.uri.startswith("jdbc:"):
            low, high = SqlSource(self.uri, query=f"SELECT MIN({self.id_column}) AS a, MAX({self.id_column}) AS b FROM {self.table_name}", options=self.options).frame(spark).first()
            parts = max(1, -(-((high or 0) - (low or 0) + 1) // self.chunk_size))
            options = {**self.options, "partitionColumn": self.id_column, "lowerBound": str(low or 0), "upperBound": str((high or 0) + 1), "numPartitions": str(parts)}
            return SqlSource(self.uri, table_name=self.table_name, options=options).frame(spark)
        table = SqlSource(self.uri, table_name=self.table_name, options=self.options).frame(spark)
        return expand_ranges(self.anchors(spark), table, self.id_column, self.chunk_size)

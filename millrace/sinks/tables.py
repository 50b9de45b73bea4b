"""Databases, tables, topics, and records handed back to Python."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import ConfigError
from millrace.sinks.base import Sink, local, make_parent
from millrace.sources.sql import sqlite_path


class SqlSink(Sink):
    """mode replace, append or fail. By JDBC all tasks write; a SQLite file has one writer, the driver, in chunks."""

    can_split = observes = False

    def __init__(self, uri: str, table_name: str, mode: str = "replace", batch_size: int = 500, options: dict[str, str] | None = None, **more):
        super().__init__(None, **more)
        if mode not in ("replace", "append", "fail"):
            raise ConfigError(f"unknown mode {mode}")
        self.uri, self.table_name, self.mode, self.batch_size, self.options = uri, table_name, mode, batch_size, options or {}

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        if self.uri.startswith("jdbc:"):
            mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[self.mode]
            df.write.format("jdbc").mode(mode).options(**self.options).option("url", self.uri).option("dbtable", self.table_name).option("batchsize", self.batch_size).save()
            return {"table": self.table_name}
        if not self.uri.startswith("sqlite:"):
            raise ConfigError(f"no SQL sink for {self.uri}")
        path = sqlite_path(self.uri)
        make_parent(path)
        quoted = '"' + self.table_name.replace('"', '""') + '"'
        text = df.select(*[F.col(f"`{n}`").cast("string") for n in df.columns])
        with sqlite3.connect(path) as db:
            if self.mode == "replace":
                db.execute(f"DROP TABLE IF EXISTS {quoted}")
            exists = db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table_name,)).fetchone()
            if self.mode == "fail" and exists:
                raise ConfigError(f"table {self.table_name} exists")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted} (" + ", ".join(f'"{n}" TEXT' for n in df.columns) + ")")
            put = f"INSERT INTO {quoted} (" + ", ".join(f'"{n}"' for n in df.columns) + ") VALUES (" + ", ".join("?" * len(df.columns)) + ")"
            n, block = 0, []
            for row in text.toLocalIterator(prefetchPartitions=True):
                block.append(tuple(row))
                if len(block) >= self.batch_size:
                    db.executemany(put, block)
                    n, block = n + len(block), []
            db.executemany(put, block)
        return {"table": self.table_name, "rows": n + len(block)}


class KafkaSink(Sink):
    """The record as JSON, or its value column as it is, to kafka://host:port/topic. Needs Spark's Kafka package."""

    def __init__(self, uri: str, acks: int = 1, timeout: int = 30, **more):
        super().__init__(None, **more)
        from millrace.sources.tables import KafkaSource

        at = KafkaSource(uri)
        self.servers, self.topic = at.servers, at.topic
        self.acks, self.timeout = acks if acks in (0, 1, -1) else 1, timeout

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, "kafka.acks": str(self.acks), "kafka.delivery.timeout.ms": str(max(self.timeout, 1) * 1000)}

    def payload(self, df: DataFrame) -> DataFrame:
        df = self.chosen(df)
        if df.columns == ["value"] and df.dtypes[0][1] in ("string", "binary"):
            return df
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def write(self, df: DataFrame) -> dict:
        self.payload(df).write.format("kafka").options(**self.options()).save()
        return {"topic": self.topic}


class DeltaSink(Sink):
    """Appends to a Delta table: files first, by all tasks, and then one commit of the log. Other modes are refused."""

    def __init__(self, table_uri: str, mode: str = "append", schema=None, storage_options: dict[str, str] | None = None, **more):
        super().__init__(table_uri.rstrip("/"), single=False, **more)
        if mode != "append":
            raise ConfigError("only append is supported")
        self.schema = schema

    def stage(self, df: DataFrame) -> dict:
        """Writes files that no version names yet."""
        from millrace.plans.deltalog import staged_files

        df = self.chosen(df)
        folder = f"{local(self.path)}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return {"adds": staged_files(local(self.path), folder), "schema": df.schema}

    def write(self, df: DataFrame) -> dict:
        from millrace.plans.deltalog import commit

        done = self.stage(df)
        return {"version": commit(local(self.path), done["adds"], done["schema"] if self.schema is None else self.schema)}

    def coordinator(self):
        from millrace.plans.coordinators import DeltaCoordinator

        return DeltaCoordinator(self.path, self.schema)

    def split(self, workers: int) -> list[Sink]:
        return [self] * workers


class IcebergSink(Sink):
    """Appends through the connector (catalog_table), or else adds Parquet files to the table's data folder."""

    def __init__(self, table_location: str, catalog_table: str | None = None, **more):
        super().__init__(table_location.rstrip("/"), single=False, **more)
        self.catalog_table = catalog_table

    def write(self, df: DataFrame) -> dict:
        df = self.chosen(df)
        if self.catalog_table:
            df.writeTo(self.catalog_table).append()
        else:
            df.write.mode("append").parquet(f"{self.path}/data")
        return {"path": self.path}

    def coordinator(self):
        from millrace.plans.coordinators import IcebergCoordinator

        return IcebergCoordinator(self.path)

    def split(self, workers: int) -> list[Sink]:
        return [self] * workers


class IteratorSink(Sink):
    """The records as an iterator of dicts; partitions are fetched one ahead."""

    can_split = observes = False

    def __init__(self, **more):
        super().__init__(None, **more)
        self._rows: Iterator | None = None

    def write(self, df: DataFrame) -> dict:
        self._rows = self.chosen(df).toLocalIterator(prefetchPartitions=True)
        return {}

    def __iter__(self) -> Iterator[dict]:
        for row in self._rows or ():
            yield row.asDict(recursive=True)

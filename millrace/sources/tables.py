"""Tables and topics: Delta, Iceberg, Kafka. Without their connectors, Delta's log and Iceberg's data folder are read directly."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import ConfigError
from millrace.sources.base import Source


class DeltaSource(Source):
    """The active files of a Delta table at a version (the last one if none is given).

    files restricts it to some of them; an empty list is an empty part.
    """

    def __init__(self, table_uri: str, version: int | None = None, files: list[str] | None = None, storage_options: dict[str, str] | None = None, **more):
        super().__init__(**more)
        self.table_uri, self.version, self.files, self.storage_options = table_uri, version, files, storage_options or {}

    def active_files(self) -> list[str]:
        from millrace.plans.deltalog import replay

        return self.files if self.files is not None else replay(self.table_uri, self.version).files

    def read(self, spark: SparkSession) -> DataFrame:
        from millrace.plans.deltalog import replay

        state = replay(self.table_uri, self.version)
        files = self.files if self.files is not None else state.files
        if not files:
            return spark.createDataFrame([], state.schema)
        if not state.partitions:
            reader = spark.read.schema(state.schema) if state.schema is not None and len(state.schema) else spark.read
            return reader.parquet(*files)
        # Values of partition columns stand in the log, by file; files of one partition are read together.
        inside = T.StructType([f for f in state.schema.fields if f.name not in state.partitions])
        groups: dict[tuple, list[str]] = {}
        for file, add in zip(state.files, state.adds.values(), strict=True):
            if file in set(files):
                groups.setdefault(tuple(add["partitionValues"].get(c) for c in state.partitions), []).append(file)
        parts = []
        for values, some in groups.items():
            held = {c: F.lit(v or None).cast(state.schema[c].dataType) for c, v in zip(state.partitions, values, strict=True)}
            parts.append(spark.read.schema(inside).parquet(*some).select(*[held[f.name].alias(f.name) if f.name in held else F.col(f"`{f.name}`") for f in state.schema.fields]))
        while len(parts) > 1:
            parts = [a[0].unionByName(a[1]) if len(a) > 1 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
        return parts[0]

    def batches(self, spark: SparkSession):
        """Records one after the other, without a pipe."""
        return self.frame(spark).toLocalIterator()

    def split(self, workers: int) -> list[Source]:
        """Parts of equal numbers of files, filled up with empty ones to exactly workers."""
        files = self.active_files()
        each = max(1, -(-len(files) // max(1, workers)))
        return [DeltaSource(self.table_uri, self.version, files[i * each : (i + 1) * each], self.storage_options) for i in range(workers)]


class IcebergSource(Source):
    """An Iceberg table through its connector where Spark has it; else the Parquet files of its data folder."""

    def __init__(self, table_location: str, files: list[str] | None = None, catalog_table: str | None = None, **more):
        super().__init__(**more)
        self.table_location, self.files, self.catalog_table = table_location.rstrip("/"), files, catalog_table

    def data_files(self) -> list[str]:
        if self.files is not None:
            return self.files
        folder = f"{self.table_location.removeprefix('file://')}/data"
        return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))

    def read(self, spark: SparkSession) -> DataFrame:
        if self.catalog_table:
            return spark.table(self.catalog_table)
        if self.files is not None:
            return spark.read.parquet(*self.files)
        return spark.read.option("recursiveFileLookup", True).parquet(f"{self.table_location}/data")

    def split(self, workers: int) -> list[Source]:
        """Runs of files next to each other, the remainder to the last."""
        files = self.data_files()
        workers = max(1, min(workers, len(files)))
        each = len(files) // workers
        cuts = [i * each for i in range(workers)] + [len(files)]
        return [IcebergSource(self.table_location, files[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class KafkaSource(Source):
    """kafka://host:port/topic. frame() reads what is there now; stream() reads on.

    Needs Spark's Kafka package; it can't be tried without a broker.
    """

    def __init__(self, uri: str, group_id: str | None = None, options: dict[str, str] | None = None, **more):
        super().__init__(**more)
        found = re.fullmatch(r"kafka://([^/]+)/([^/]+)", uri)
        if not found:
            raise ConfigError(f"Invalid Kafka URI: {uri} (expected kafka://host:port/topic)")
        self.servers, self.topic = found[1], unquote(found[2])
        self.group_id, self.more = group_id, options or {}

    def options(self) -> dict[str, str]:
        own = {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "startingOffsets": "earliest"}
        return own | ({"kafka.group.id": self.group_id} if self.group_id else {}) | self.more

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("kafka").options(**self.options()).load().select("key", "value", "topic", "partition", "offset", "timestamp")

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.format("kafka").options(**self.options()).load().select("key", "value", "topic", "partition", "offset", "timestamp")


def read_json_lines(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        return [json.loads(x) for x in file if x.strip()]

"""What happens once for all parts of a run: before it, after it, and when it fails."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import SparkSession

from millrace.model import WorkerResult
from millrace.sinks.base import Sink, join_parquet, local, remove
from millrace.sources.base import Source

FIRST, NORMAL, LAST = 0, 50, 100


class Coordinator:
    """priority: lower starts first and finishes last."""

    priority = NORMAL

    def prepare_shards(self, part: Source | Sink, workers: int) -> list:
        """Parts of a source or sink, or an empty list if another coordinator is to make them."""
        return []

    def on_start(self, manager) -> None: ...

    def on_finish(self, manager, results: list[WorkerResult]) -> None: ...

    def on_error(self, manager, error: BaseException) -> None: ...


class CompositeCoordinator(Coordinator):
    def __init__(self, coordinators: list[Coordinator]):
        self.coordinators = sorted(coordinators, key=lambda c: c.priority)

    def prepare_shards(self, part, workers: int) -> list:
        return next((s for c in self.coordinators if (s := c.prepare_shards(part, workers))), [])

    def on_start(self, manager) -> None:
        for c in self.coordinators:
            c.on_start(manager)

    def on_finish(self, manager, results: list[WorkerResult]) -> None:
        for c in reversed(self.coordinators):
            c.on_finish(manager, results)

    def on_error(self, manager, error: BaseException) -> None:
        for c in self.coordinators:
            c.on_error(manager, error)


class ShardingCoordinator(Coordinator):
    """Splits what can be split; a sink that can't is shared."""

    priority = LAST

    def prepare_shards(self, part, workers: int) -> list:
        if isinstance(part, Sink):
            return part.split(workers) if part.can_split else [part] * workers
        return part.split(workers) if part.can_split else [part]


class MergeCoordinator(Coordinator):
    """Joins part files to one: one header for CSV, one array for JSON, whole tables for Parquet and Arrow.

    Only after all parts succeeded. Text is copied in blocks, and never as a whole.
    """

    def __init__(self, target: str, remove_parts: bool = True):
        self.target, self.remove_parts = target, remove_parts

    def on_finish(self, manager, results: list[WorkerResult]) -> None:
        parts = [local(r.output_path) for r in sorted(results, key=lambda r: r.worker_id) if r.output_path and os.path.exists(local(r.output_path))]
        if not parts or not all(r.success for r in results):
            return
        merge_files(parts, local(self.target))
        if self.remove_parts:
            for p in parts:
                if p != local(self.target):
                    shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)


def merge_files(parts: list[str], target: str) -> None:
    name = target.removesuffix(".gz").removesuffix(".zst")
    packed = name != target
    if name.endswith(".parquet"):
        if not join_parquet(SparkSession.builder.getOrCreate(), [f"file://{os.path.abspath(p)}" for p in parts], f"file://{os.path.abspath(target)}.merging"):
            import pyarrow.dataset as ds
            import pyarrow.parquet as pq

            data = ds.dataset(parts)
            with pq.ParquetWriter(f"{target}.merging", data.schema) as out:
                for batch in data.to_batches():
                    out.write_batch(batch)
        folder, name = os.path.split(f"{target}.merging")
        remove(os.path.join(folder, f".{name}.crc"))
    elif name.endswith((".arrow", ".ipc", ".feather")):
        import pyarrow as pa

        with pa.ipc.new_file(f"{target}.merging", pa.ipc.open_file(parts[0]).schema) as out:
            for p in parts:
                reader = pa.ipc.open_file(p)
                for i in range(reader.num_record_batches):
                    out.write_batch(reader.get_batch(i))
    elif name.endswith(".json") and not packed:
        with open(f"{target}.merging", "w", encoding="utf-8") as out:
            first = True
            out.write("[")
            for p in parts:
                with open(p, encoding="utf-8") as file:
                    text = file.read().strip()
                inner = text[1:-1].strip() if text.startswith("[") else ",".join(json.dumps(json.loads(x), ensure_ascii=False) for x in text.splitlines() if x.strip())
                if inner:
                    out.write(("" if first else ",") + inner)
                    first = False
            out.write("]")
    else:
        # A packed file may have several members, one after the other; but a header must then go from its text.
        header = name.endswith((".csv", ".tsv"))
        with _raw(f"{target}.merging", "wb", packed and header, target) as out:
            for k, p in enumerate(parts):
                with _raw(p, "rb", packed and header, target) as file:
                    if header and k:
                        file.readline()
                    shutil.copyfileobj(file, out, 1 << 20)
    os.replace(f"{target}.merging", target)


def _raw(path: str, mode: str, unpack: bool, target: str):
    if not unpack:
        return open(path, mode)
    if target.endswith(".gz"):
        import gzip

        return gzip.open(path, mode)
    import io

    import zstandard

    file = zstandard.open(path, mode)
    return io.BufferedReader(file) if mode == "rb" else file


class DeltaCoordinator(Coordinator):
    """One commit for the files of all parts, which are staged without one."""

    priority = FIRST

    def __init__(self, table_uri: str, schema=None):
        self.table_uri, self.schema = table_uri, schema

    def on_start(self, manager) -> None:
        from millrace.plans.deltalog import create

        if self.schema is not None:
            create(local(self.table_uri), self.schema)

    def on_finish(self, manager, results: list[WorkerResult]) -> None:
        from millrace.plans.deltalog import commit

        staged = [r.metrics["staged"] for r in results if r.success and "staged" in r.metrics]
        adds = [a for s in staged for a in s["adds"]]
        if adds:
            commit(local(self.table_uri), adds, self.schema if self.schema is not None else staged[0]["schema"])


class IcebergCoordinator(Coordinator):
    """Keeps the parts of a table in one place. With the connector each write is a commit of its own; without it, there are
    no snapshots to commit, and files count once they are in the data folder."""

    priority = FIRST

    def __init__(self, table_location: str):
        self.table_location = table_location

    def prepare_shards(self, part, workers: int) -> list:
        return [part] * workers if isinstance(part, Sink) else []

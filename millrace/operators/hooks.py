"""Hooks: user code before and after validation, as column transforms or on batches of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import ERR, ID, META, POSITION, RAW, STATUS, VALID, Status

VERY_HIGH, HIGH, NORMAL, LOW, VERY_LOW = 0, 25, 50, 75, 100


class Hook:
    """priority: lower runs first; hooks of equal priority keep their order."""

    def __init__(self, priority: int = NORMAL):
        self.priority = priority

    def setup(self, store: dict) -> None:
        """On the driver before a run; store is shared with teardown."""

    def teardown(self, store: dict) -> None:
        """On the driver after a run, whatever became of it."""


class ColumnHook(Hook):
    """A transform of the enveloped DataFrame; Spark optimises it with the rest of the plan.

    function takes the records as a DataFrame of plain columns (of the validated data, if
    there is any, else of the raw data) and returns one, with rows added, changed or left out.
    """

    def __init__(self, function: Callable[[DataFrame], DataFrame], priority: int = NORMAL):
        super().__init__(priority)
        self.function = function

    def apply(self, df: DataFrame) -> DataFrame:
        data = VALID if VALID in df.columns else RAW
        envelope = [c for c in df.columns if c != data]
        flat = self.function(df.select(*envelope, f"{data}.*"))
        fields = [c for c in flat.columns if c not in envelope]
        none = F.col(STATUS) == Status.FAILED.value if data == VALID else F.lit(False)
        return flat.select(*envelope, F.when(~none, F.struct(*fields)).alias(data))


class BatchHook(Hook):
    """execute(entries, store) takes and returns a list of entries; it may change, drop or add some.

    An entry has id, position, status, raw_data, metadata, errors and, after validation,
    validated_data. store is new for each batch and shared by the hooks that run on it.
    adds: DDL of fields that the hook gives to the data (validated, or else raw).
    """

    adds = ""

    def __init__(self, priority: int = NORMAL, adds: str | None = None):
        super().__init__(priority)
        self.adds = adds if adds is not None else type(self).adds

    def execute(self, entries: list[dict[str, Any]], store: dict) -> list[dict[str, Any]]:
        return entries


def apply_hooks(df: DataFrame, hooks: list[Hook], *, route_errors: bool = False) -> DataFrame:
    """df after the hooks, by priority; neighbouring batch hooks run together, on the same batches."""
    batch: list[BatchHook] = []
    for hook in sorted(hooks, key=lambda h: h.priority):
        if isinstance(hook, BatchHook):
            batch.append(hook)
            continue
        df = hook.apply(_run_batches(df, batch, route_errors) if batch else df)
        batch = []
    return _run_batches(df, batch, route_errors) if batch else df


NAMES = {ID: "id", POSITION: "position", STATUS: "status", RAW: "raw_data", VALID: "validated_data", ERR: "errors", META: "metadata"}


def _run_batches(df: DataFrame, hooks: list[BatchHook], route_errors: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    data = VALID if VALID in df.columns else RAW
    added = [f for h in hooks if h.adds for f in T.StructType.fromDDL(h.adds).fields]
    schema = T.StructType([T.StructField(f.name, _extended(f.dataType, added) if f.name == data else f.dataType, True) for f in df.schema.fields])
    arrow = to_arrow_schema(schema)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = [{NAMES[c]: row[c] for c in columns} for row in batch.to_pylist(maps_as_pydicts="strict")]
            for e in entries:
                e["metadata"] = e["metadata"] or {}
                e["errors"] = e["errors"] or []
                if e.get("validated_data", 0) is None:
                    del e["validated_data"]
            store: dict = {}
            for hook in hooks:
                try:
                    entries = list(hook.execute(entries, store))
                except Exception as e:
                    if not route_errors:
                        raise
                    for x in entries:
                        x["status"] = Status.FAILED.value
                        x["errors"].append({"msg": str(e), "type": "hook_error", "loc": [type(hook).__name__]})
            rows = [{c: _plain(e.get(NAMES[c])) for c in columns} for e in entries]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def _plain(value: Any) -> Any:
    return value.value if isinstance(value, Status) else value


def _extended(kind: T.StructType, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in kind.fields if f.name not in names] + added)

"""Validated record pipelines on Spark: sources, hooks, a Pydantic model, and sinks for what passes and what fails."""

from millrace.model import ConfigError, PipelineError, PipeState, Report, Status, WorkerResult, get_logger
from millrace.operators import BatchHook, ColumnHook, Validator, expand_ranges, lookup, page_anchors
from millrace.plans import CompositeCoordinator, Coordinator, DeltaCoordinator, IcebergCoordinator, MergeCoordinator, Pipe, PipeManager, ShardingCoordinator
from millrace.sinks import ArrowSink, CsvSink, DeltaSink, ExcelSink, IcebergSink, IteratorSink, JsonSink, KafkaSink, ParquetSink, SqlSink
from millrace.sources import ArrowSource, BytesSource, CsvSource, DeltaSource, ExcelSource, FrameSource, IcebergSource, JsonSource, KafkaSource, PagedSqlSource, ParquetSource, RowsSource, SqlSource
from millrace.streaming import run_stream, stream_files
from millrace.telemetry import Telemetry

__version__ = "0.1.0"
__all__ = [
    "ArrowSink", "ArrowSource", "BatchHook", "BytesSource", "ColumnHook", "CompositeCoordinator", "ConfigError", "Coordinator", "CsvSink", "CsvSource", "DeltaCoordinator", "DeltaSink", "DeltaSource",
    "ExcelSink", "ExcelSource", "FrameSource", "IcebergCoordinator", "IcebergSink", "IcebergSource", "IteratorSink", "JsonSink", "JsonSource", "KafkaSink", "KafkaSource", "MergeCoordinator", "PagedSqlSource",
    "ParquetSink", "ParquetSource", "Pipe", "PipeManager", "PipeState", "PipelineError", "Report", "RowsSource", "ShardingCoordinator", "SqlSink", "SqlSource", "Status", "Telemetry", "Validator",
    "WorkerResult", "expand_ranges", "get_logger", "lookup", "page_anchors", "run_stream", "stream_files",
]

"""Sinks: each writes the records of a DataFrame."""

from millrace.sinks.base import Sink, part_path
from millrace.sinks.files import ArrowSink, CsvSink, ExcelSink, JsonSink, ParquetSink
from millrace.sinks.tables import DeltaSink, IcebergSink, IteratorSink, KafkaSink, SqlSink

__all__ = ["ArrowSink", "CsvSink", "DeltaSink", "ExcelSink", "IcebergSink", "IteratorSink", "JsonSink", "KafkaSink", "ParquetSink", "Sink", "SqlSink", "part_path"]

"""Sources: each gives a DataFrame of raw records."""

from millrace.sources.base import Source, byte_ranges, count_rows, file_size
from millrace.sources.files import ArrowSource, CsvSource, ExcelSource, JsonSource, ParquetSource
from millrace.sources.rows import BytesSource, FrameSource, RowsSource
from millrace.sources.sql import PagedSqlSource, SqlSource
from millrace.sources.tables import DeltaSource, IcebergSource, KafkaSource

__all__ = [
    "ArrowSource", "BytesSource", "CsvSource", "DeltaSource", "ExcelSource", "FrameSource", "IcebergSource", "JsonSource", "KafkaSource",
    "PagedSqlSource", "ParquetSource", "RowsSource", "Source", "SqlSource", "byte_ranges", "count_rows", "file_size",
]

"""A pipe for each micro-batch of a stream, with offsets kept in a checkpoint."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.model import Report
from millrace.plans.pipe import Pipe


def stream_files(spark: SparkSession, path: str, schema, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def run_stream(stream: DataFrame, pipe: Pipe, checkpoint: str, *, every: str | None = None, report: Report | None = None) -> StreamingQuery:
    """Starts the stream; without `every` (a processing time like "10 seconds") it ends when it has read what is there.

    Sinks get the batch in a folder of its own, batch=<n>: a batch that is run again after
    a failure replaces what it wrote before, so each record is there once. Sinks without a
    path get the batch as it is, and may see a repeated one.
    """
    report = report if report is not None else pipe.report
    report.begin()

    def of_batch(sink, n: int):
        if sink is None or sink.path is None:
            return sink
        own = copy.copy(sink)
        own.path, own.single = f"{sink.path}/batch={n}", False
        return own

    def each(df: DataFrame, n: int) -> None:
        sinks = of_batch(pipe.sink, n), of_batch(pipe.error_sink, n)
        total, bad = pipe.process(df, sinks)
        report.total_processed += total
        report.error_count += bad
        report.success_count += total - bad

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

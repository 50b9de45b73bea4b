"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Formats are timed in rows a second, written and read by whole pipes; `rows_per_s` has
them beside the seconds. Each query runs once untimed on the smallest tables, so that
code is loaded and compiled.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
WARM = "/root/testdata/sf0.001"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cases(spark, sf_dir: str, at: str):
    """name: (what to run, rows)."""
    import millrace as m
    from millrace import catalog

    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lineitem.count()
    flat = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")

    def pipe(source, sink, **more):
        p = m.Pipe(source, sink, spark=spark, **more)
        p.start(wait=True)
        if p.report.exception:
            raise p.report.exception

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    formats = {
        "csv": (m.CsvSink(f"{at}/l.csv", single=False), m.CsvSource(f"{at}/l.csv", fieldnames=flat.columns, has_header=True)),
        "jsonl": (m.JsonSink(f"{at}/l.jsonl", format="jsonl", single=False), m.JsonSource(f"{at}/l.jsonl", lines=True, schema=flat.schema)),
        "parquet": (m.ParquetSink(f"{at}/l"), m.ParquetSource(f"{at}/l")),
        "arrow": (m.ArrowSink(f"{at}/l.arrow", single=False), m.ArrowSource(f"{at}/l.arrow")),
        "delta": (m.DeltaSink(f"{at}/delta"), m.DeltaSource(f"{at}/delta")),
    }
    for name, (sink, source) in formats.items():
        yield f"{name}_write", lambda sink=sink: pipe(m.FrameSource(flat), sink), n
        yield f"{name}_read", lambda source=source: drain(source.frame(spark)), n
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.count()
    for name in ("validate_success", "validate_errors", "validate_custom_model", "batch_hook_python", "status_report"):
        yield name, lambda name=name: drain(catalog.QUERIES[name](spark, sf_dir)), e
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    yield "heavy_etl", lambda: drain(catalog.QUERIES["heavy_etl"](spark, sf_dir)), c
    for name in ("sql_expansion", "lookup_enrich"):
        yield name, lambda name=name: drain(catalog.QUERIES[name](spark, sf_dir)), spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    yield "sql_query_source", lambda: drain(catalog.QUERIES["sql_query_source"](spark, sf_dir)), n


def main() -> None:
    out, sys.stdout = sys.stdout, sys.stderr
    spark, seconds, rates = session(), {}, {}
    for sf_dir in (WARM, SF_DIR):
        at = tempfile.mkdtemp(prefix="bench-")
        try:
            for name, run, rows in cases(spark, sf_dir, at):
                began = time.time()
                run()
                seconds[name] = round(time.time() - began, 3)
                rates[name] = round(rows / max(seconds[name], 1e-3))
        finally:
            shutil.rmtree(at, ignore_errors=True)
    spark.stop()
    print(json.dumps({"metric": "seconds, all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_s": rates, "sf": os.path.basename(SF_DIR).removeprefix("sf")}), file=out)


if __name__ == "__main__":
    main()

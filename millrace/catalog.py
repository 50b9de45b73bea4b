"""Queries over the test tables, one or more for each operator, and SQL that must give the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from enum import Enum
from typing import Annotated, Literal, Optional

from pydantic import BaseModel, ConfigDict, Field, field_validator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace as m
from millrace.functions.coerce import compat_cast
from millrace.model import ERR, POSITION, RAW, STATUS, enveloped
from millrace.operators.route import failed, succeeded
from millrace.plans.coordinators import merge_files
from millrace.sinks.base import join_parquet
from millrace.sources.base import count_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def workspace(spark: SparkSession) -> str:
    """A new folder, in the shared folder if the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.removeprefix('file://').removeprefix('file:').rstrip('/')}/work-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="millrace-")
    os.makedirs(folder, exist_ok=True)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through(spark: SparkSession, df: DataFrame, sink: m.ParquetSink, source) -> DataFrame:
    """The records of df after a pipe into sink, as source reads them back."""
    pipe = m.Pipe(m.FrameSource(df), sink, spark=spark)
    pipe.start(wait=True)
    if pipe.report.exception:
        raise pipe.report.exception
    return source.frame(spark)


def typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


class Kind(str, Enum):
    view, signup, purchase, click = "view", "signup", "purchase", "click"


class Event(BaseModel):
    event_id: int
    event_type: Literal["view", "signup", "purchase", "click"]
    value: int


class Order(BaseModel):
    model_config = ConfigDict(extra="ignore")
    o_orderkey: Annotated[int, Field(gt=0)]
    o_orderstatus: Literal["O", "F"]
    o_totalprice: Annotated[float, Field(ge=1000, lt=300000)]
    o_orderpriority: Annotated[str, Field(min_length=5, max_length=10)]


class TextEvent(BaseModel):
    event_id: int
    user_id: Annotated[int, Field(ge=10)]
    value: float
    note: Optional[str] = "none"


class Custom(BaseModel):
    event_id: int
    value: float

    @field_validator("value")
    @classmethod
    def small(cls, v: float) -> float:
        if v >= 50:
            raise ValueError("too large")
        return v * 2


# -- scans ------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def scan_project(spark, sf_dir):
    source = m.ParquetSource(f"{sf_dir}/lineitem.parquet")
    source.require(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return source.frame(spark)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def scan_limit_offset(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")
    return m.FrameSource(ordered, limit=100, offset=50).frame(spark)


@query("SELECT count(*) AS n FROM lineitem")
def count_records(spark, sf_dir):
    return spark.createDataFrame([(count_rows(spark, m.ParquetSource(f"{sf_dir}/lineitem.parquet")),)], "n long")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size >= 25 AND p_brand <> ''")
def scan_filter_pushdown(spark, sf_dir):
    return m.ParquetSource(f"{sf_dir}/part.parquet").frame(spark).filter("p_size >= 25 and p_brand <> ''").select("p_partkey", "p_brand", "p_retailprice")


# -- round trips --------------------------------------------------------------
@query("SELECT * FROM customer")
def csv_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "customer"), f"{workspace(spark)}/customer.csv"
    return typed(through(spark, df, m.CsvSink(at, single=False), m.CsvSource(at, fieldnames=df.columns, has_header=True)), df)


@query("SELECT * FROM supplier")
def csv_quoted_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "supplier"), f"{workspace(spark)}/supplier.tsv"
    return typed(through(spark, df, m.CsvSink(at, delimiter="\t", quotechar="'"), m.CsvSource(at, delimiter="\t", quotechar="'")), df)


@query("SELECT * FROM supplier")
def jsonl_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "supplier"), f"{workspace(spark)}/supplier.jsonl"
    return typed(through(spark, df, m.JsonSink(at, format="jsonl"), m.JsonSource(at)), df)


@query("SELECT * FROM nation")
def json_array_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "nation"), f"{workspace(spark)}/nation.json"
    return typed(through(spark, df, m.JsonSink(at, indent=2), m.JsonSource(at)), df)


@query("SELECT * FROM part")
def parquet_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "part"), f"{workspace(spark)}/part"
    return through(spark, df, m.ParquetSink(at), m.ParquetSource(at))


@query("SELECT * FROM orders")
def arrow_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "orders"), f"{workspace(spark)}/orders"
    return typed(through(spark, df, m.ArrowSink(at, single=False), m.ArrowSource(at)), df)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def excel_roundtrip(spark, sf_dir):
    at = f"{workspace(spark)}/nation.xlsx"
    return through(spark, table(spark, sf_dir, "nation"), m.ExcelSink(at, sheet_name="nations"), m.ExcelSource(at, sheet="nations"))


@query("SELECT * FROM part")
def gzip_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "part"), f"{workspace(spark)}/part.csv.gz"
    return typed(through(spark, df, m.CsvSink(at), m.CsvSource(at)), df)


@query("SELECT * FROM part")
def zstd_roundtrip(spark, sf_dir):
    df, at = table(spark, sf_dir, "part"), f"{workspace(spark)}/part.jsonl.zst"
    return typed(through(spark, df, m.JsonSink(at, format="jsonl"), m.JsonSource(at)), df)


@query("SELECT r_regionkey, r_name FROM region")
def iterator_roundtrip(spark, sf_dir):
    df, sink = table(spark, sf_dir, "region"), m.IteratorSink()
    pipe = m.Pipe(m.FrameSource(df), sink, spark=spark)
    pipe.start(wait=True)
    return typed(m.RowsSource(iter(sink), chunk=2).frame(spark), df)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def sqlite_roundtrip(spark, sf_dir):
    uri = f"sqlite:{workspace(spark)}/t.db"
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return through(spark, df, m.SqlSink(uri, "supplier"), m.SqlSource(uri, table_name="supplier"))


# -- validation and routing ----------------------------------------------------
@query("SELECT event_id, event_type, CAST(value AS BIGINT) AS value FROM events WHERE value = floor(value) AND event_type <> 'error'")
def validate_success(spark, sf_dir):
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), model=Event, spark=spark).plan())


@query("SELECT event_id, event_type, value FROM events WHERE NOT (value = floor(value) AND event_type <> 'error')")
def validate_errors(spark, sf_dir):
    return failed(m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), model=Event, spark=spark).plan())


@query("""SELECT event_id, 'value' AS field, 'int_from_float' AS code FROM events WHERE value <> floor(value)
UNION ALL SELECT event_id, 'event_type', 'literal_error' FROM events WHERE event_type = 'error'""")
def validate_error_detail(spark, sf_dir):
    plan = m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), model=Event, spark=spark).plan()
    return plan.select(F.col(f"{RAW}.event_id").alias("event_id"), F.explode(ERR).alias("e")).select("event_id", F.col("e.loc")[0].alias("field"), F.col("e.type").alias("code"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE o_orderkey > 0 AND o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 AND o_totalprice < 300000 AND length(o_orderpriority) BETWEEN 5 AND 10""")
def validate_constraints(spark, sf_dir):
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/orders.parquet"), model=Order, spark=spark).plan())


@query("""SELECT event_id, user_id, value, 'none' AS note FROM events
WHERE user_id >= 10 AND regexp_full_match(CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS VARCHAR), '[+-]?[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?')""")
def validate_strings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string"))
    text = events.select(F.col("event_id").cast("string"), F.col("user_id").cast("string"), value.alias("value"))
    return succeeded(m.Pipe(m.FrameSource(text), model=TextEvent, spark=spark).plan())


@query("SELECT event_id, value * 2 AS value FROM events WHERE value < 50")
def validate_custom_model(spark, sf_dir):
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), model=Custom, spark=spark).plan())


@query("""SELECT count(*) AS total, count(*) FILTER (value = floor(value) AND event_type <> 'error') AS success,
count(*) FILTER (NOT (value = floor(value) AND event_type <> 'error')) AS error FROM events""")
def status_report(spark, sf_dir):
    at = workspace(spark)
    pipe = m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), m.ParquetSink(f"{at}/good"), m.ParquetSink(f"{at}/bad"), model=Event, spark=spark)
    pipe.start(wait=True)
    r = pipe.report
    if r.exception:
        raise r.exception
    return spark.createDataFrame([(r.total_processed, r.success_count, r.error_count)], "total long, success long, error long")


@query("SELECT c_custkey, c_name FROM customer")
def passthrough(spark, sf_dir):
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/customer.parquet"), spark=spark).plan()).select("c_custkey", "c_name")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def envelope_position(spark, sf_dir):
    ordered = table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey")
    return enveloped(ordered, positions=True).select(F.col(f"{RAW}.c_custkey").alias("c_custkey"), F.col(POSITION).alias("position"))


# -- hooks ----------------------------------------------------------------------
class Upper(m.BatchHook):
    def execute(self, entries, store):
        store["seen"] = len(entries)
        for e in entries:
            e["raw_data"]["event_type"] = e["raw_data"]["event_type"].upper()
        return entries


class Double(m.BatchHook):
    adds = "batch boolean"

    def execute(self, entries, store):
        for e in entries:
            e["raw_data"]["batch"] = store["seen"] == len(entries)
        return [e for e in entries if e["raw_data"]["value"] >= 50]


@query("SELECT c_custkey, upper(c_name) AS c_name, c_acctbal FROM customer")
def pre_hook_upper(spark, sf_dir):
    hook = m.ColumnHook(lambda df: df.withColumn("c_name", F.upper("c_name")))
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/customer.parquet"), pre_hooks=[hook], spark=spark).plan()).select("c_custkey", "c_name", "c_acctbal")


class Part(BaseModel):
    p_partkey: int
    p_size: Annotated[int, Field(ge=1)]


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_size >= 18 AS is_adult FROM part WHERE p_size >= 1")
def post_hook_enrich(spark, sf_dir):
    hook = m.ColumnHook(lambda df: df.withColumn("is_adult", F.col("p_size") >= 18))
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/part.parquet"), model=Part, post_hooks=[hook], spark=spark).plan())


@query("SELECT doc_id, lang FROM documents WHERE n_chars < 500")
def hook_filter(spark, sf_dir):
    hook = m.ColumnHook(lambda df: df.filter("n_chars < 500"))
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/documents.parquet"), pre_hooks=[hook], spark=spark).plan()).select("doc_id", "lang")


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def hook_flatmap(spark, sf_dir):
    hook = m.ColumnHook(lambda df: df.withColumn("line", F.explode(F.split("text", "\n", -1))))
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/documents.parquet"), pre_hooks=[hook], spark=spark).plan()).select("doc_id", "line")


@query("SELECT event_id, upper(event_type) AS event_type, value, true AS batch FROM events WHERE value >= 50")
def batch_hook_python(spark, sf_dir):
    source = m.FrameSource(table(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    return succeeded(m.Pipe(source, pre_hooks=[Upper(), Double()], spark=spark).plan())


@query("SELECT event_id, upper(event_type) AS event_type FROM events WHERE event_type <> 'view'")
def hook_priority(spark, sf_dir):
    late = m.ColumnHook(lambda df: df.withColumn("event_type", F.upper("event_type")), priority=75)
    early = m.ColumnHook(lambda df: df.filter("event_type <> 'view'"), priority=25)
    return succeeded(m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), pre_hooks=[late, early], spark=spark).plan()).select("event_id", "event_type")


def heavy(df: DataFrame) -> DataFrame:
    name = F.lower(F.trim("c_name"))
    number = F.coalesce(F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("long") % 10, F.lit(0))
    return df.select("c_custkey", name.alias("name"), F.sha2(name, 256).alias("digest"), number.alias("bucket"), F.when(F.length(F.trim("c_name")) < 5, "skipped").otherwise("done").alias("state"))


@query("""SELECT c_custkey, lower(trim(c_name)) AS name, sha256(lower(trim(c_name))) AS digest,
coalesce(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) % 10, 0) AS bucket,
CASE WHEN length(trim(c_name)) < 5 THEN 'skipped' ELSE 'done' END AS state FROM customer""")
def heavy_etl(spark, sf_dir):
    return heavy(table(spark, sf_dir, "customer"))


# -- SQL, ranges, lookups ---------------------------------------------------------
@query("SELECT low AS min_id, low + 999 AS max_id FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1, 1000)) AS low FROM orders)")
def pagination_anchors(spark, sf_dir):
    return m.page_anchors(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sql_expansion(spark, sf_dir):
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").createOrReplaceTempView("paged_orders")
    return m.PagedSqlSource("spark:", "paged_orders", "o_orderkey", 1000).frame(spark)


@query("""SELECT o_orderkey, o_custkey, s_name, CASE WHEN s_suppkey IS NULL THEN 'not found' END AS error
FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""")
def lookup_enrich(spark, sf_dir):
    """Fewer suppliers than customers exist, so many keys have no match."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return m.lookup(orders, table(spark, sf_dir, "supplier"), "o_custkey", table_key="s_suppkey", columns=["s_name"])


REVENUE = """SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY o_orderpriority"""


@query(REVENUE)
def sql_query_source(spark, sf_dir):
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return m.SqlSource("spark:", query=REVENUE).frame(spark)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    props = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


# -- parts, reports, tables, streams ------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def shard_merge(spark, sf_dir):
    at, df = workspace(spark), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    through(spark, df, m.ParquetSink(f"{at}/in.parquet", single=True), m.ParquetSource(f"{at}/in.parquet"))
    pipe = m.Pipe(m.ParquetSource(f"{at}/in.parquet"), m.ParquetSink(f"{at}/out.parquet", single=True), spark=spark)
    m.PipeManager.parallelize(pipe, 3).run()
    return m.ParquetSource(f"{at}/out.parquet").frame(spark)


@query("SELECT n_nationkey, n_name FROM nation")
def csv_parts_merge(spark, sf_dir):
    at, df = workspace(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for i, sink in enumerate(m.CsvSink(f"{at}/n.csv").split(3)):
        through(spark, df.filter(f"n_nationkey % 3 = {i}"), sink, m.CsvSource(sink.path))
    merge_files([s.path for s in m.CsvSink(f"{at}/n.csv").split(3)], f"{at}/n.csv")
    return typed(m.CsvSource(f"{at}/n.csv").frame(spark), df)


@query("""SELECT 0 AS pipe, count(*) AS total, count(*) AS success, 0 AS error FROM nation
UNION ALL SELECT 1, count(*), count(*), 0 FROM region
UNION ALL SELECT 2, count(*), count(*) FILTER (value = floor(value) AND event_type <> 'error'), count(*) FILTER (NOT (value = floor(value) AND event_type <> 'error')) FROM events
UNION ALL SELECT 3, CAST(sum(t) AS BIGINT), CAST(sum(s) AS BIGINT), CAST(sum(t - s) AS BIGINT) FROM (SELECT count(*) AS t, count(*) AS s FROM nation UNION ALL SELECT count(*), count(*) FROM region
UNION ALL SELECT count(*), count(*) FILTER (value = floor(value) AND event_type <> 'error') FROM events)""")
def many_pipes_report(spark, sf_dir):
    at = workspace(spark)
    pipes = [m.Pipe(m.ParquetSource(f"{sf_dir}/{n}.parquet"), m.ParquetSink(f"{at}/{n}"), model=model, spark=spark) for n, model in (("nation", None), ("region", None), ("events", Event))]
    manager = m.PipeManager(pipes)
    manager.run()
    rows = [(i, r.total_processed, r.success_count, r.error_count) for i, r in enumerate([*manager.pipe_reports, manager.report])]
    return spark.createDataFrame(rows, "pipe int, total long, success long, error long")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def delta_append_read(spark, sf_dir):
    return m.DeltaSource(_delta(spark, sf_dir)).frame(spark)


@query("SELECT n_nationkey, n_name FROM nation")
def delta_version(spark, sf_dir):
    return m.DeltaSource(_delta(spark, sf_dir), version=1).frame(spark)


def _delta(spark, sf_dir) -> str:
    at = f"{workspace(spark)}/t"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    for df in (nation, region):
        through(spark, df, m.DeltaSink(at), m.DeltaSource(at))
    return at


@query("SELECT * FROM nation")
def iceberg_files_read(spark, sf_dir):
    at = f"{workspace(spark)}/t"
    return through(spark, table(spark, sf_dir, "nation"), m.IcebergSink(at), m.IcebergSource(at))


@query("SELECT event_id, event_type, CAST(value AS BIGINT) AS value FROM events WHERE value = floor(value) AND event_type <> 'error'")
def stream_validate(spark, sf_dir):
    at, events = workspace(spark), table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(f"{at}/in")
    pipe = m.Pipe(m.FrameSource(events), m.ParquetSink(f"{at}/out"), model=Event, spark=spark)
    done = m.run_stream(m.stream_files(spark, f"{at}/in", events.schema, max_files=1), pipe, f"{at}/state")
    done.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("""SELECT event_id, CASE WHEN lower(props) = 'true' OR props = '1' THEN true ELSE false END AS as_bool,
CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS as_long, CAST(user_id AS DOUBLE) AS as_double FROM events""")
def coerce_first_record(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = {f.name: f.dataType for f in events.schema.fields}
    cast = lambda c, t: compat_cast(F.col(c), kind[c], t)
    return events.select("event_id", cast("props", "boolean").alias("as_bool"), cast("value", "long").alias("as_long"), cast("user_id", "double").alias("as_double"))


@query("SELECT CASE WHEN value = floor(value) AND event_type <> 'error' THEN 'validated' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    plan = m.Pipe(m.ParquetSource(f"{sf_dir}/events.parquet"), model=Event, spark=spark).plan()
    return plan.groupBy(F.col(STATUS).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(text, '') AS text, lang FROM documents")
def csv_text_roundtrip(spark, sf_dir):
    """Cells with line breaks, quotes and commas. A cell can't be null, so another column tells which languages are."""
    at, df = workspace(spark), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    back = through(spark, df.withColumn("no_lang", F.isnull("lang")), m.CsvSink(f"{at}/x.csv"), m.CsvSource(f"{at}/x.csv"))
    return typed(back.withColumn("lang", F.when(back.no_lang == "false", back.lang)), df)


@query("SELECT * FROM nation")
def csv_bytes(spark, sf_dir):
    at, df = workspace(spark), table(spark, sf_dir, "nation")
    through(spark, df, m.CsvSink(f"{at}/x.csv"), m.CsvSource(f"{at}/x.csv"))
    with open(f"{at}/x.csv", "rb") as file:
        return typed(m.BytesSource(file.read(), "csv").frame(spark), df)


@query("SELECT * FROM region")
def json_bytes(spark, sf_dir):
    at, df = workspace(spark), table(spark, sf_dir, "region")
    through(spark, df, m.JsonSink(f"{at}/x.jsonl", format="jsonl"), m.JsonSource(f"{at}/x.jsonl"))
    with open(f"{at}/x.jsonl", "rb") as file:
        return typed(m.BytesSource(file.read(), "json", schema=df.schema).frame(spark), df)


@query("SELECT (SELECT count(*) FROM customer) AS records, (SELECT count(*) FROM (DESCRIBE customer)) AS columns")
def csv_count_headers(spark, sf_dir):
    at, df = workspace(spark), table(spark, sf_dir, "customer")
    through(spark, df, m.CsvSink(f"{at}/x.csv"), source := m.CsvSource(f"{at}/x.csv"))
    return spark.createDataFrame([(count_rows(spark, source), len(source.headers(spark)))], "records long, columns long")


@query("SELECT k, CASE WHEN k >= 15 THEN 'late' END AS later, CASE WHEN k < 10 THEN 1.0 * k ELSE k + 0.5 END AS n FROM (SELECT unnest(range(0, 20)) AS k)")
def rows_later_fields(spark, sf_dir):
    """Fields that first appear, and types that change, after the first chunk."""
    rows = ({"k": k, "n": k if k < 10 else k + 0.5} | ({"later": "late"} if k >= 15 else {}) for k in range(20))
    return m.RowsSource(rows, chunk=7).frame(spark).select("k", "later", "n")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def delta_partitioned_read(spark, sf_dir):
    """A table whose partition column stands in the log alone, whose first version is a checkpoint."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    at, df = f"{workspace(spark)}/t", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    df.write.partitionBy("n_regionkey").parquet(f"file://{at}")
    names = sorted(os.path.relpath(os.path.join(d, f), at) for d, _, files in os.walk(at) for f in files if f.endswith(".parquet"))
    adds = [{"path": n, "partitionValues": [("n_regionkey", n.partition("=")[2].partition("/")[0])], "size": os.path.getsize(f"{at}/{n}")} for n in names]
    meta = {"id": "t", "schemaString": df.schema.json(), "partitionColumns": ["n_regionkey"], "configuration": []}
    values = pa.map_(pa.string(), pa.string())
    kinds = {
        "protocol": pa.struct([("minReaderVersion", pa.int32()), ("minWriterVersion", pa.int32())]),
        "metaData": pa.struct([("id", pa.string()), ("schemaString", pa.string()), ("partitionColumns", pa.list_(pa.string())), ("configuration", values)]),
        "add": pa.struct([("path", pa.string()), ("partitionValues", values), ("size", pa.int64())]),
    }
    rows = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}, *({"add": a} for a in adds[:-1])]
    os.makedirs(f"{at}/_delta_log")
    pq.write_table(pa.table({k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()}), f"{at}/_delta_log/{3:020d}.checkpoint.parquet")
    with open(f"{at}/_delta_log/{4:020d}.json", "w") as file:
        file.write(json.dumps({"add": adds[-1] | {"partitionValues": dict(adds[-1]["partitionValues"])}}) + "\n")
    return m.DeltaSource(at).frame(spark)


@query("SELECT p_partkey, p_name FROM part")
def parquet_row_groups(spark, sf_dir):
    """Each row group by its number, put together again."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    at, df = workspace(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    schema = to_arrow_schema(df.schema)

    def write(batches):
        name = f"{at}/{uuid.uuid4().hex}.parquet"
        with pq.ParquetWriter(name, schema) as out:
            rest = schema.empty_table()
            for batch in batches:
                rest = pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(schema)])
                if full := rest.num_rows // 500 * 500:
                    out.write_table(rest.slice(0, full), row_group_size=500)
                    rest = rest.slice(full)
            if rest.num_rows:
                out.write_table(rest)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    names = [r[0] for r in df.mapInArrow(write, "name string").collect()]  # a row per task
    join_parquet(spark, names, f"{at}/x.parquet")
    for name in names:
        os.remove(name)
    parts = [s.frame(spark) for s in m.ParquetSource(f"{at}/x.parquet").split(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]) if len(parts) == 3 else parts[0]


@query("SELECT n_name FROM nation WHERE n_regionkey < 3")
def delta_batches(spark, sf_dir):
    """Active files and records of a Delta table, without a pipe."""
    at, df = f"{workspace(spark)}/t", table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_name")
    through(spark, df, m.DeltaSink(at), source := m.DeltaSource(at))
    assert source.active_files()
    return spark.createDataFrame([(r["n_name"],) for r in source.batches(spark)], "n_name string")

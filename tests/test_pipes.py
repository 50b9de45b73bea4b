"""Scenarios of whole pipes on tiny inputs."""

from __future__ import annotations

import gzip
import json
import sqlite3
from typing import Optional

import pytest
from pydantic import BaseModel, ConfigDict
from pyspark.sql import functions as F

import millrace as m
from millrace import catalog
from millrace.model import PipeState
from millrace.sinks.base import part_path
from millrace.sources.files import json_values, row_group_rows


class User(BaseModel):
    model_config = ConfigDict(extra="ignore")
    user_id: str
    username: str
    age: int


class Open(BaseModel):
    model_config = ConfigDict(extra="allow")
    user_id: str
    age: int


class Nested(BaseModel):
    user_id: str
    metadata: dict[str, str]


CSV = "user_id,username,age\n1,alice,30\n2,bob,{age}\n"


def write(path, text: str) -> str:
    path.write_text(text)
    return str(path)


def run(*args, **more) -> m.Pipe:
    pipe = m.Pipe(*args, **more)
    assert pipe.run()
    if pipe.report.exception:
        raise pipe.report.exception
    return pipe


def lines(path) -> list[dict]:
    with open(path) as file:
        return [json.loads(x) for x in file]


def test_csv_to_csv(spark, tmp_path):
    p = run(m.CsvSource(write(tmp_path / "a.csv", CSV.format(age=25))), m.CsvSink(str(tmp_path / "deep" / "b.csv")), model=User)
    assert (p.report.success_count, p.report.error_count) == (2, 0) and p.report.state is PipeState.COMPLETED
    assert (tmp_path / "deep" / "b.csv").read_text().splitlines() == ["user_id,username,age", "1,alice,30", "2,bob,25"]


def test_one_bad_row_fails_alone(spark, tmp_path):
    p = run(m.CsvSource(write(tmp_path / "a.csv", CSV.format(age="invalid"))), m.JsonSink(str(tmp_path / "g.jsonl"), format="jsonl"), m.CsvSink(str(tmp_path / "e.csv")), model=User)
    assert (p.report.total_processed, p.report.success_count, p.report.error_count) == (2, 1, 1)
    assert lines(tmp_path / "g.jsonl") == [{"user_id": "1", "username": "alice", "age": 30}]
    assert (tmp_path / "e.csv").read_text().splitlines()[1] == "2,bob,invalid"


def test_tab_quote_fieldnames_and_skip(spark, tmp_path):
    at = write(tmp_path / "a.tsv", "user_id\tusername\tage\n1\t'al\tice'\t30\n")
    assert m.CsvSource(at, delimiter="\t", quotechar="'").frame(spark).first().username == "al\tice"
    bare = write(tmp_path / "b.csv", "1,alice,30\n2,bob,\n")
    assert [tuple(r) for r in m.CsvSource(bare, fieldnames=["a", "b", "c"]).frame(spark).collect()] == [("1", "alice", "30"), ("2", "bob", "")]
    noted = write(tmp_path / "c.csv", "# note\na,b\n1,2\n3,4\n")
    assert [tuple(r) for r in m.CsvSource(noted, skip_rows=1).frame(spark).collect()] == [("1", "2"), ("3", "4")]
    assert m.CsvSource(noted, skip_rows=1, limit=1).frame(spark).count() == 1


def test_ragged_row_fails(spark, tmp_path):
    p = m.Pipe(m.CsvSource(write(tmp_path / "a.csv", "a,b\n1,2\n3\n")), m.CsvSink(str(tmp_path / "b.csv")))
    p.run()
    assert p.report.has_error and p.report.state is PipeState.FAILED and not (tmp_path / "b.csv").exists()


def test_empty_inputs(spark, tmp_path):
    p = run(m.CsvSource(write(tmp_path / "a.csv", "user_id,username,age\n")), m.CsvSink(str(tmp_path / "b.csv")), model=User)
    assert p.report.total_processed == 0
    p = run(m.JsonSource(write(tmp_path / "a.jsonl", ""), schema="user_id string, username string, age long"), m.JsonSink(str(tmp_path / "b.json")), model=User)
    assert p.report.total_processed == 0 and (tmp_path / "b.json").read_text() == "[]"


@pytest.mark.parametrize("text", ['{"a": 1}{"a": 2}', '[{"a": 1}, {"a": 2}]', '[{"a": 1}] {"a": 2}', '[]\n{"a": 1}\n[{"a": 2}]'])
def test_json_values(spark, tmp_path, text):
    assert [json.loads(x)["a"] for x in json_values(text)] == [1, 2]
    assert sorted(r.a for r in m.JsonSource(write(tmp_path / "a.json", text)).frame(spark).collect()) == [1, 2]


def test_nested_model_and_open_model(spark, tmp_path):
    at = write(tmp_path / "a.jsonl", '{"user_id": "1", "metadata": {"role": "admin"}}\n')
    run(m.JsonSource(at, schema="user_id string, metadata map<string,string>"), m.JsonSink(str(tmp_path / "b.jsonl"), format="jsonl"), model=Nested)
    assert lines(tmp_path / "b.jsonl")[0]["metadata"]["role"] == "admin"
    assert m.Validator(Open).required_columns() is None and not m.Validator(Open).native


def test_compressed_text(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write(CSV.format(age=25))
    run(m.CsvSource(str(tmp_path / "a.csv.gz")), m.CsvSink(str(tmp_path / "b.csv.zst")), model=User)
    assert m.CsvSource(str(tmp_path / "b.csv.zst")).frame(spark).count() == 2


class Flags(m.BatchHook):
    def setup(self, store):
        store["up"] = True

    def teardown(self, store):
        store["down"] = True

    def execute(self, entries, store):
        for e in entries:
            e["metadata"]["seen"] = "yes"
        return entries


class Bad(m.BatchHook):
    def execute(self, entries, store):
        raise ValueError("no")


def test_hooks(spark, tmp_path):
    source = m.RowsSource([{"user_id": "1", "username": "al", "age": "3"}])
    p = run(source, m.IteratorSink(), model=User, pre_hooks=[Flags()])
    assert p._store == {"up": True, "down": True}
    assert p.plan().first()["_metadata_map"] == {"seen": "yes"}
    broken = m.Pipe(source, m.IteratorSink(), m.JsonSink(str(tmp_path / "e.jsonl"), format="jsonl"), pre_hooks=[Bad()])
    broken.run()
    assert broken.report.has_error
    routed = run(source, m.ParquetSink(str(tmp_path / "g")), m.JsonSink(str(tmp_path / "e.jsonl"), format="jsonl"), post_hooks=[Bad()], on_hook_error="route", include_errors=True)
    assert routed.report.error_count == 1 and lines(tmp_path / "e.jsonl")[0]["_errors"][0]["type"] == "hook_error"


def test_csv_cells_keep_their_edges(spark, tmp_path):
    texts = [" a ", "\ta\n", "\n", " ", "\r", "a\r\nb\r\n", '\n"a', ' "a" ', "\x0b", "\x00", "a,\n", '"', '"\n"', None]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["csv_text_roundtrip"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.text, r.lang) for r in got] == [(t or "", "en" if i % 2 else None) for i, t in enumerate(texts)]


def test_ids_and_positions(spark):
    rows = m.Pipe(m.RowsSource([{"a": i} for i in range(100)], chunk=7), positions=True).plan().collect()
    assert len({r["_id"] for r in rows}) == 100 and all(len(r["_id"]) == 32 for r in rows)
    assert sorted((r["_position"], r["_raw"]["a"]) for r in rows) == [(i, i) for i in range(100)]


def test_positions_of_sorted_rows(spark):
    """A sort cuts its partitions by a sample, another one in each run."""
    df = spark.range(600_000).select(((F.col("id") * 7919) % 600_000).alias("a")).orderBy("a")
    plan = m.Pipe(m.FrameSource(df), positions=True, spark=spark).plan()
    assert plan.filter("_raw.a <> _position").count() == 0 and plan.count() == 600_000


def test_excel(spark, tmp_path):
    at = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame([("x<&>", 1.5, True, None), ("y", 2.0, False, "t")], "s string, d double, b boolean, n string")
    m.ExcelSink(at, sheet_name="one & two", fieldnames=["d", "s", "b", "n"]).write(df)
    assert m.ExcelSource(at).sheets() == ["one & two"]
    for sheet in (None, 0, "one & two"):
        assert [tuple(r) for r in m.ExcelSource(at, sheet).frame(spark).collect()] == [(1.5, "x<&>", True, None), (2.0, "y", False, "t")]
    assert m.ExcelSource(at, skip_rows=1, fieldnames=["a", "b"]).frame(spark).count() == 2
    with pytest.raises(ValueError):
        m.ExcelSource(at, "none").frame(spark)


def test_parquet_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"a": list(range(1000))}), at, row_group_size=300)
    assert row_group_rows(at) == [300, 300, 300, 100]
    assert {r.a for r in m.ParquetSource(at, row_groups=[1, 3]).frame(spark).collect()} == {*range(300, 600), *range(900, 1000)}
    parts = m.ParquetSource(at).split(3)
    assert [len(p.row_groups) for p in parts] == [1, 1, 2] and sum(p.frame(spark).count() for p in parts) == 1000
    assert len(m.ParquetSource(at).split(9)) == 4


def test_many_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"a": list(range(30000))}), at, row_group_size=10)
    assert [p.frame(spark).count() for p in m.ParquetSource(at).split(3)] == [10000] * 3
    odd = m.ParquetSource(at, row_groups=list(range(1, 3000, 2))).frame(spark)
    assert {r.a for r in odd.collect()} == {i for i in range(30000) if i // 10 % 2}
    assert m.ParquetSource(at, row_groups=[]).frame(spark).count() == 0 and [r.a for r in m.ParquetSource(at, row_groups=[-1, -1]).frame(spark).collect()] == list(range(29990, 30000))


def test_single_files_are_written_in_parallel(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(0, 4000, 1, 4).withColumn("at", F.spark_partition_id())
    at = str(tmp_path / "a.parquet")
    m.ParquetSink(at, single=True).write(df)
    assert row_group_rows(at) == [1000] * 4 and pq.read_table(at)["id"].to_pylist() == list(range(4000))
    m.PipeManager.parallelize(m.Pipe(m.ParquetSource(at), m.ParquetSink(str(tmp_path / "b.parquet"), single=True), spark=spark), 3).run()
    assert pq.read_table(tmp_path / "b.parquet")["id"].to_pylist() == list(range(4000)) and sorted(x.name for x in tmp_path.iterdir()) == ["a.parquet", "b.parquet"]
    assert m.ParquetSource(str(tmp_path / "b.parquet")).frame(spark).dtypes == df.dtypes
    want = "id,at\n" + "".join(f"{i},{i // 1000}\n" for i in range(4000))
    m.CsvSink(str(tmp_path / "a.csv")).write(df)
    m.CsvSink(str(tmp_path / "a.csv.gz")).write(df)
    m.CsvSink(str(tmp_path / "none.csv")).write(df.filter("id < 0"))
    m.JsonSink(str(tmp_path / "a.jsonl"), format="jsonl").write(df)
    assert (tmp_path / "a.csv").read_text() == want == gzip.open(tmp_path / "a.csv.gz", "rt").read() and (tmp_path / "none.csv").read_text() == "id,at\n"
    assert [x["id"] for x in lines(tmp_path / "a.jsonl")] == list(range(4000)) and m.CsvSource(str(tmp_path / "a.csv.gz")).frame(spark).count() == 4000


def test_sqlite(spark, tmp_path):
    uri = f"sqlite:{tmp_path}/deep/a.db"
    df = spark.createDataFrame([("1", "al", None), ("2", "bo", "x")], "id string, name string, note string")
    m.SqlSink(uri, "users").write(df)
    m.SqlSink(uri, "users", mode="append").write(df)
    assert m.SqlSource(uri, table_name="users").frame(spark).count() == 4
    assert [r.id for r in m.SqlSource(uri, query="SELECT id FROM users WHERE id = '2' AND note = 'x'").frame(spark).collect()] == ["2", "2"]
    with pytest.raises(m.ConfigError):
        m.SqlSink(uri, "users", mode="fail").write(df)
    with pytest.raises(m.ConfigError):
        m.SqlSource(uri)
    with sqlite3.connect(f"{tmp_path}/p.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(1, 501)])
    paged = m.PagedSqlSource(f"sqlite:{tmp_path}/p.db", "t", "id", 50)
    assert paged.anchors(spark).count() == 10 and paged.frame(spark).distinct().count() == 500


def test_delta_parts_and_conflict(spark, tmp_path):
    parts = m.DeltaSource("/t", files=[str(i) for i in range(10)])
    assert [len(p.files) for p in parts.split(3)] == [4, 4, 2] and [len(p.files) for p in parts.split(12)] == [1] * 10 + [0, 0]
    at = str(tmp_path / "t")
    df = spark.range(4).withColumn("x", F.lit("a"))
    assert m.DeltaSink(at).write(df)["version"] == 1 and m.DeltaSink(at).write(df)["version"] == 2
    assert m.DeltaSource(at).frame(spark).count() == 8 and m.DeltaSource(at, version=1).frame(spark).count() == 4 and m.DeltaSource(at, version=0).frame(spark).count() == 0
    with pytest.raises(m.PipelineError):
        m.DeltaSource(at, version=9).frame(spark)
    manager = m.PipeManager.parallelize(m.Pipe(m.DeltaSource(at), m.DeltaSink(str(tmp_path / "u")), spark=spark), 2)
    manager.run()
    assert m.DeltaSource(str(tmp_path / "u")).frame(spark).count() == 8 and manager.report.total_processed == 8
    assert len(m.DeltaSource(str(tmp_path / "u"), version=1).active_files()) == len(m.DeltaSource(str(tmp_path / "u")).active_files())


def test_kafka_options():
    source = m.KafkaSource("kafka://host:9092/topic", group_id="g")
    assert source.options() == {"kafka.bootstrap.servers": "host:9092", "subscribe": "topic", "startingOffsets": "earliest", "kafka.group.id": "g"}
    assert m.KafkaSink("kafka://host:9092/topic", acks=5).options()["kafka.acks"] == "1"
    with pytest.raises(m.ConfigError, match="Invalid Kafka URI"):
        m.KafkaSource("http://host/topic")


def test_manager(spark, tmp_path):
    good, bad = write(tmp_path / "a.csv", CSV.format(age=25)), write(tmp_path / "b.csv", "user_id,username,age\n3,eve,x\n")
    manager = m.PipeManager([m.Pipe(m.CsvSource(f), m.CsvSink(f + ".out"), model=User, spark=spark) for f in (good, bad)])
    with pytest.raises(m.PipelineError, match="before start"):
        _ = manager.pipe_reports
    manager.run()
    assert (manager.report.total_processed, manager.report.success_count, manager.report.error_count) == (3, 2, 1)
    with pytest.raises(IndexError):
        manager.pipe_report(7)


def test_coordinators_run_in_order(spark, tmp_path):
    log = []

    class Note(m.Coordinator):
        def __init__(self, name, priority):
            self.name, self.priority = name, priority

        def on_start(self, manager):
            log.append(f"start {self.name}")

        def on_finish(self, manager, results):
            log.append(f"finish {self.name}")

        def on_error(self, manager, error):
            log.append(f"error {self.name}")

    at = write(tmp_path / "a.csv", CSV.format(age=25))
    m.PipeManager([m.Pipe(m.CsvSource(at), m.CsvSink(f"{at}.out"), spark=spark)], [Note("b", 60), Note("a", 10)]).run()
    assert log == ["start a", "start b", "finish b", "finish a"]
    log.clear()
    with pytest.raises(Exception, match="."):
        m.PipeManager([m.Pipe(m.CsvSource(str(tmp_path / "none.csv")), m.CsvSink(f"{at}.out"), spark=spark)], [Note("b", 60), Note("a", 10)]).run()
    assert log == ["start a", "start b", "error a", "error b"]


def test_bytes_and_ranges(spark):
    assert [tuple(r) for r in m.BytesSource(b"a,b\n1,\n2,x\n", "csv").frame(spark).collect()] == [("1", ""), ("2", "x")]
    assert sorted(r.a for r in m.BytesSource(b'[{"a": 1}] {"a": 2}', "json").frame(spark).collect()) == [1, 2]
    with pytest.raises(m.ConfigError):
        m.BytesSource(b"a,b\n1\n", "csv").frame(spark)
    from millrace.sources import byte_ranges

    assert byte_ranges(100, 1) == [(0, None)] and byte_ranges(101, 3) == [(0, 33), (33, 66), (66, None)]


def test_iceberg_parts_and_pickled_pipe(spark, tmp_path):
    import pickle

    at = str(tmp_path / "t")
    pipe = m.Pipe(m.RowsSource([{"a": i} for i in range(6)]), m.IcebergSink(at), spark=spark)
    manager = m.PipeManager.parallelize(pipe, 2)
    manager.run()
    assert m.IcebergSource(at).frame(spark).count() == 6 and sum(p.frame(spark).count() for p in m.IcebergSource(at).split(2)) == 6
    assert pickle.loads(pickle.dumps(pipe)).sink.path == at


def test_part_names():
    assert part_path("s3://bucket/a/b.csv.gz", 0) == "s3://bucket/a/b_part_1.csv.gz" and part_path("b.jsonl", 2) == "b_part_3.jsonl"


def test_report():
    r = m.Report()
    assert r.items_per_second == 0 and r.duration == 0 and not r.is_finished
    r.begin()
    r.total_processed = 100
    r.start_time -= 0.1
    r.finish(PipeState.COMPLETED)
    assert 500 < r.items_per_second < 2000
    worse = m.Report(exception=ValueError("x"), state=PipeState.FAILED)
    assert m.Report.aggregate([r, worse]).state is PipeState.FAILED


def test_start_twice_and_shutdown(spark, tmp_path):
    def slow(it):
        import time

        for b in it:
            time.sleep(20)
            yield b

    df = spark.range(2).mapInArrow(slow, "id long")
    with m.Pipe(m.FrameSource(df), m.ParquetSink(str(tmp_path / "o"))) as p:
        p.start()
        with pytest.raises(m.PipelineError, match="once at a time"):
            p.start()
        assert not p.wait(0.2)
    assert p.report.state is PipeState.ABORTED


class Loose(BaseModel):
    i: int
    f: float
    b: bool
    o: Optional[int] = None


def test_validation_equals_the_model(spark):
    """Compiled checks against the model itself, on texts made of everything that numbers are made of."""
    import random

    from pydantic import ValidationError

    r = random.Random(8)
    parts = ["0", "1", "12", "-", "+", ".", ".0", "e", "E5", "_", " ", "\t", "nan", "inf", "Infinity", "true", "off", "Y", "٣", " ", "f", "99999999999999999999", "0x1", ""]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 4))) for _ in range(4000)]
    rows = [(k, t, r.choice(texts), r.choice(texts), r.choice([None, "7", t])) for k, t in enumerate(texts)]
    rows = [(k, i, f if k % 3 else "1.5", b if k % 2 else "yes", o) for k, i, f, b, o in rows]
    df = spark.createDataFrame(rows, "k int, i string, f string, b string, o string")
    plan = m.Pipe(m.FrameSource(df), model=Loose, pre_hooks=[m.ColumnHook(lambda d: d)], spark=spark).plan()
    got = {x["_raw"]["k"]: x for x in plan.collect()}
    for k, i, f, b, o in rows:
        x = got[k]
        try:
            want = Loose.model_validate({"i": i, "f": f, "b": b, "o": o}).model_dump()
        except ValidationError as e:
            assert x["_status"] == "failed", (i, f, b, o)
            assert sorted((z["loc"][0], z["type"]) for z in x["_errors"]) == sorted((str(z["loc"][0]), z["type"]) for z in e.errors()), (i, f, b, o)
            continue
        if abs(want["i"]) >= 2**63 or abs(want["o"] or 0) >= 2**63:
            assert x["_errors"][0]["type"] == "int_out_of_range"
            continue
        assert x["_status"] == "validated" and repr(x["_validated"].asDict()) == repr(want), (i, f, b, o)


def test_tables_that_need_more_of_a_reader_are_refused(spark, tmp_path):
    import json

    df = spark.range(3)
    at = str(tmp_path / "t")
    m.Pipe(m.FrameSource(df), m.DeltaSink(at), spark=spark).run()
    for k, action in enumerate([{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"]}}, {"protocol": {"minReaderVersion": 2, "minWriterVersion": 5}}, {"add": {"path": "x", "deletionVector": {"storageType": "u"}}}]):
        path = f"{at}/_delta_log/{2:020d}.json"
        with open(path, "w") as file:
            file.write(json.dumps(action))
        with pytest.raises(m.PipelineError):
            m.DeltaSource(at).frame(spark)
        assert m.DeltaSource(at, version=1).frame(spark).count() == 3


def test_a_later_text_in_a_column_of_numbers(spark, tmp_path):
    import sqlite3

    path = tmp_path / "x.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a, b)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i if i < 1500 else "many", i) for i in range(1600)])
    got = m.SqlSource(f"sqlite:{path}", table_name="t").frame(spark)
    assert dict(got.dtypes) == {"a": "string", "b": "bigint"} and got.filter("a = 'many'").count() == 100


def test_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x\ny ""q"""\n2,z\n')
    rows = [("1", 'x\ny "q"'), ("2", "z")]
    assert [tuple(r) for r in m.CsvSource(str(path)).frame(spark).collect()] == rows
    assert [tuple(r) for r in m.CsvSource(str(path), multiline=True).frame(spark).collect()] == rows


def test_counts_while_a_pipe_runs(spark, tmp_path):
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.05)
            yield b

    seen = []
    df = spark.range(0, 40_000, 1, 24).mapInArrow(slow, "id long")
    pipe = m.Pipe(m.FrameSource(df), m.ParquetSink(str(tmp_path / "x"), single=False), spark=spark)
    pipe.run(on_report_update=lambda r: seen.append(r.total_processed), interval=0.02)
    assert seen == sorted(seen) and seen[-1] == 40_000


def test_parts_keep_settings(spark):
    pipe = m.Pipe(m.FrameSource(spark.range(2)), prune_columns=False, native_validation=False, spark=spark)
    assert all(not p.prune_columns and not p.native_validation for p in m.PipeManager.parallelize(pipe, 2).pipes)

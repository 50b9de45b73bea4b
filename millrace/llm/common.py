"""Helpers that the text operators share: staging, hashing, document batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; only where that is unset and Spark runs in one
    process (tests) a temporary folder is made and set as checkpoint folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


class Scratch:
    """Parquet tables below the shared folder, to cut lineage and to reuse results.

    A written table survives the loss of any executor, and its size is known to
    the planner when it is read again.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{purpose}-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back, with the same schema."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that keep() returned and that nothing reads any more."""
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if folder.rpartition("/")[0].endswith(self.root.rpartition("/")[2]):
                jvm = self.spark._jvm
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed so that no column of df has one of them, in any case."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


#: Most bits of a table that is sent to all tasks: 8 MB.
MOST_BITS = 1 << 26


def _marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, str] | None:
    """rows with a column, and its name, that is true where the key may be in wanted; None if wanted is too large for a table that tells."""
    n = wanted.count()
    if 4 * n > MOST_BITS:
        return None
    bits = min(MOST_BITS, 1 << max(10, (32 * n - 1).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    at, word, bits_of, hit = fresh(rows, "slot", "word", "mask", "hit")
    mask = wanted.select(slot(wanted_key).alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias(bits_of))
    marked = rows.withColumn(at, slot(key)).join(F.broadcast(mask), F.shiftright(at, 6) == F.col(word), "left")
    return marked.withColumn(hit, F.coalesce(F.expr(f"shiftrightunsigned({bits_of}, cast({at} & 63 as int)) & 1") == 1, F.lit(False))).drop(at, word, bits_of), hit


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key may be in wanted: all that are, and few of the others while wanted has less than some millions of rows.

    The keys' hashes are bits of a table that is sent to every task and never has more than
    MOST_BITS bits; a larger `wanted` lets more other rows through, and none is lost.
    """
    marked = _marked(rows, key, wanted, wanted_key)
    return rows if marked is None else marked[0].filter(marked[1]).drop(marked[1])


def unlikely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows that `likely` leaves out, none of whose keys is in wanted."""
    marked = _marked(rows, key, wanted, wanted_key)
    return rows.limit(0) if marked is None else marked[0].filter(f"not {marked[1]}").drop(marked[1])


def crc_mod(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % divisor


def map_texts(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(function, schema)


def rows_out(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

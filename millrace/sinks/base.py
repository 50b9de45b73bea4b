"""What all sinks share, and files that one task or the driver writes."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def part_path(path: str, part: int) -> str:
    """<stem>_part_<n><suffix>, n from 1; nothing else of the path changes, whatever its scheme."""
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.partition(".")
    return f"{folder}{slash}{stem}_part_{part + 1}{dot}{suffix}"


class Sink:
    """single: one file at exactly the path, joined from what tasks write in parallel; else a folder of part files, written in parallel.

    fieldnames choose and order the columns; names that a record lacks are null.
    """

    can_split = True
    #: Whether write() runs a query over all rows that Spark observes.
    observes = True

    def __init__(self, path: str | None = None, *, single: bool = True, fieldnames: list[str] | None = None, sort_columns: bool = False):
        self.path, self.single, self.fieldnames, self.sort_columns = path, single, fieldnames, sort_columns

    def hooks(self) -> list:
        return []

    def coordinator(self):
        """The sink's own coordinator, for what is committed once for all parts."""
        return None

    def chosen(self, df: DataFrame) -> DataFrame:
        names = self.fieldnames or (sorted(df.columns) if self.sort_columns else df.columns)
        return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])

    def write(self, df: DataFrame) -> dict:
        """Writes all records and returns what a coordinator has to know."""
        raise NotImplementedError

    def split(self, workers: int) -> list[Sink]:
        import copy

        out = []
        for i in range(workers):
            part = copy.copy(self)
            part.path = part_path(self.path, i) if self.path else self.path
            out.append(part)
        return out


def local(path: str) -> str:
    return path.removeprefix("file://")


def make_parent(path: str) -> None:
    if "://" not in path or path.startswith("file://"):
        os.makedirs(os.path.dirname(local(path)) or ".", exist_ok=True)


def write_single(df: DataFrame, path: str, kind: str, options: dict) -> None:
    """One file at path: parts that tasks write in parallel beside it, joined in their order by the driver, which copies
    bytes and holds none of them, and renamed when it is complete."""
    make_parent(path)
    if options.get("compression") == "zstd":  # Spark writes no text in it; the one file is packed as a stream
        plain = f"{path}.{uuid.uuid4().hex}.text"
        write_single(df, plain, kind, {k: v for k, v in options.items() if k != "compression"})
        _pack(local(plain), local(path))
        return
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, jvm = hadoop(df, path), df.sparkSession._jvm
    header = options.get("header", False)
    df.write.format(kind).options(**(options | {"header": False} if header else options)).save(f"{beside}/parts")
    parts = _parts(fs, jvm, f"{beside}/parts")
    if header:
        df.limit(0).write.format(kind).options(**options).save(f"{beside}/header")
        parts = [*_parts(fs, jvm, f"{beside}/header"), *parts]
    whole = f"{beside}/whole"
    if len(parts) == 1:
        fs.rename(jvm.org.apache.hadoop.fs.Path(parts[0]), jvm.org.apache.hadoop.fs.Path(whole))
    elif kind == "parquet":
        join_parquet(df.sparkSession, parts, whole)
    elif parts:
        _join_bytes(df.sparkSession, fs, parts, whole)
    at = jvm.org.apache.hadoop.fs.Path(path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    replaced = bool(parts) and fs.exists(at) and fs.rename(at, old)
    if parts and not fs.rename(jvm.org.apache.hadoop.fs.Path(whole), at):
        if replaced:
            fs.rename(old, at)
        raise OSError(f"{path} can't be put in place")
    if replaced:
        fs.delete(old, True)
    elif not parts:
        fs.delete(at, True)
    fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
    if "://" not in path or path.startswith("file://"):
        folder, name = os.path.split(local(path))
        crc = os.path.join(folder, f".{name}.crc")
        if os.path.exists(crc):
            os.remove(crc)


def _parts(fs, jvm, folder: str) -> list[str]:
    """The part files in the order of their tasks."""
    files = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-")]
    return [p.toString() for p in sorted(files, key=lambda p: int(p.getName().split("-")[1].partition(".")[0]))]


def _join_bytes(spark: SparkSession, fs, parts: list[str], target: str) -> None:
    """Text, or members of a packed file, one after the other."""
    jvm = spark._jvm
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target))
    try:
        for p in parts:
            file = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(file, out, spark._jsc.hadoopConfiguration(), False)
            file.close()
    finally:
        out.close()


def join_parquet(spark: SparkSession, parts: list[str], target: str) -> bool:
    """A file of the row groups of all parts in their order, copied as they are; False if the parts' columns differ, and nothing is written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.parquet.hadoop
    files = [parquet.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(p), conf) for p in parts]
    footers = []
    for file in files:
        reader = parquet.ParquetFileReader.open(file)
        footers.append(reader.getFooter())
        reader.close()
    first = footers[0].getFileMetaData()
    schema = first.getSchema()
    if not all(schema.equals(x.getFileMetaData().getSchema()) for x in footers):
        return False
    overwrite = getattr(parquet, "ParquetFileWriter$Mode").OVERWRITE
    out = parquet.ParquetFileWriter(parquet.util.HadoopOutputFile.fromPath(jvm.org.apache.hadoop.fs.Path(target), conf), schema, overwrite, 128 << 20, 0)
    out.start()
    for file, footer in zip(files, footers, strict=True):
        stream = file.newStream()
        for group in footer.getBlocks():
            if group.getRowCount():  # the writer takes no empty one
                out.appendRowGroup(stream, group, False)
        stream.close()
    out.end(first.getKeyValueMetaData())
    return True


def _pack(plain: str, path: str) -> None:
    import zstandard

    with open(plain, "rb") as file, open(f"{path}.packing", "wb") as out:
        zstandard.ZstdCompressor().copy_stream(file, out)
    os.replace(f"{path}.packing", path)
    os.remove(plain)


def hadoop(df: DataFrame, path: str):
    spark = df.sparkSession
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path)
    elif os.path.exists(path):
        os.remove(path)

"""What all sources share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Source:
    """A description of records to read; nothing is read before frame().

    limit and offset hold for the whole source, in its own order, and not for each task.
    """

    can_split = True

    def __init__(self, *, limit: int | None = None, offset: int = 0):
        self.limit, self.offset = limit, offset
        self.required: list[str] | None = None

    def require(self, columns: list[str] | None) -> None:
        """Only these columns will be asked for; unknown names are ignored, and if none is known all are read."""
        self.required = columns

    def hooks(self) -> list:
        """Hooks that belong to the source and run before the user's."""
        return []

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def frame(self, spark: SparkSession) -> DataFrame:
        df = self.read(spark)
        if self.required is not None:
            known = [c for c in df.columns if c in set(self.required)]
            df = df.select(*[F.col(f"`{c}`") for c in known]) if known else df
        if self.offset:
            df = df.offset(self.offset)
        return df if self.limit is None else df.limit(self.limit)

    def split(self, workers: int) -> list[Source]:
        """Parts for separate pipes; a single pipe needs none, since Spark splits what it reads."""
        return [self]


def count_rows(spark: SparkSession, source: Source) -> int:
    """Records of the source; Parquet is counted from its footers."""
    return source.frame(spark).count()


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def byte_ranges(size: int, parts: int) -> list[tuple[int, int | None]]:
    """Ranges of equal length, the last one open; a single part is the whole file.

    Spark aligns splits to lines by itself; this is for stores that are read by range.
    """
    if parts <= 1:
        return [(0, None)]
    step = size // parts
    return [(i * step, (i + 1) * step if i < parts - 1 else None) for i in range(parts)]

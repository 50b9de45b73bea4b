"""Key ranges as rows, their expansion by an equi-join, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_anchors(table: DataFrame, id_column: str, chunk_size: int) -> DataFrame:
    """min_id, max_id: ranges of chunk_size from the least to the greatest id of the table."""
    ends = table.agg(F.min(id_column).cast("long").alias("low"), F.max(id_column).cast("long").alias("high")).filter("low is not null")
    starts = ends.select("low", F.explode(F.sequence("low", "high", F.lit(chunk_size))).alias("min_id"))
    return starts.select("min_id", (F.col("min_id") + (chunk_size - 1)).alias("max_id"))


def expand_ranges(anchors: DataFrame, table: DataFrame, id_column: str, chunk_size: int, *, low: str = "min_id", high: str = "max_id") -> DataFrame:
    """The rows of table whose id lies in a range, once for each range.

    Both sides get the number of an id block of chunk_size, so that Spark can hash-join
    them; a range is sent to the blocks that it touches, and the range itself is checked.
    Anchors without bounds have no rows.
    """
    block = lambda c: F.floor(F.col(c) / chunk_size)
    ranges = anchors.filter(f"{low} is not null and {high} is not null and {low} <= {high}").select(F.col(low).alias("__low"), F.col(high).alias("__high"))
    ranges = ranges.withColumn("__block", F.explode(F.sequence(block("__low"), block("__high"))))
    rows = table.withColumn("__block", block(id_column))
    return rows.join(ranges, "__block").filter(F.col(id_column).between(F.col("__low"), F.col("__high"))).select(*[F.col(c) for c in table.columns])


def lookup(df: DataFrame, table: DataFrame, key: str, *, table_key: str | None = None, columns: list[str] | None = None, error_column: str = "error", error: str = "not found") -> DataFrame:
    """df with columns of the row of table that has its key; rows without one say so in error_column.

    Spark broadcasts the table only if its size allows it. A table with repeated keys
    repeats rows.
    """
    table_key = table_key or key
    columns = columns or [c for c in table.columns if c != table_key]
    other = table.select(F.col(table_key).alias("__key"), F.lit(True).alias("__found"), *columns)
    joined = df.join(other, df[key] == other["__key"], "left")
    return joined.withColumn(error_column, F.when(F.col("__found").isNull(), F.lit(error))).drop("__key", "__found")

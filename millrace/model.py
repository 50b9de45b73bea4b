"""The record envelope, statuses, reports and results."""

from __future__ import annotations

import enum
import logging
import sys
import tempfile
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERRORS = "array<struct<msg:string,type:string,loc:array<string>>>"
#: Envelope columns. The metadata map isn't called _metadata, which is Spark's own for files.
ID, POSITION, STATUS, RAW, VALID, ERR, META = "_id", "_position", "_status", "_raw", "_validated", "_errors", "_metadata_map"


class Status(str, enum.Enum):
    PENDING = "pending"
    VALIDATED = "validated"
    FAILED = "failed"


class PipeState(str, enum.Enum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    ABORTED = "aborted"


class PipelineError(RuntimeError):
    """What went wrong while a pipe read, changed or wrote records."""


class ConfigError(PipelineError):
    """A source, sink or pipe that can't be built as asked."""


def get_logger(name: str = "millrace") -> logging.Logger:
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger


def enveloped(df: DataFrame, *, generate_ids: bool = True, positions: bool = False) -> DataFrame:
    """Each row of df as raw record in an envelope.

    Ids are random (32 hex digits); position is a running number over the partitions of
    df, which are written to the checkpoint folder and counted first.
    """
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias(RAW)) if df.columns else df
    new_id = F.regexp_replace(F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"), "-", "") if generate_ids else F.lit(None).cast("string")
    out = out.withColumn(ID, new_id)
    out = _numbered(out) if positions else out.withColumn(POSITION, F.lit(None).cast("long"))
    return out.select(
        ID, POSITION, F.lit(Status.PENDING.value).alias(STATUS), RAW, F.array().cast(ERRORS).alias(ERR), F.create_map().cast("map<string,string>").alias(META)
    )


def _checkpoint_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset and Spark runs in one process, a temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='millrace-')}"


def _numbered(df: DataFrame) -> DataFrame:
    """Sorted or shuffled again, the same rows may be in other partitions; so they are counted and numbered where one run has put them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_dir(spark))
    placed = df.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((int(p), total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "__part long, __start long")
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row per partition
    return joined.withColumn(POSITION, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start", "__at")


@dataclass
class WorkerResult:
    """What became of one shard."""

    worker_id: int
    success: bool
    output_path: str | None = None
    metrics: dict = field(default_factory=dict)
    error: str | None = None


@dataclass
class Report:
    """Counters, state and times of a run."""

    total_processed: int = 0
    success_count: int = 0
    error_count: int = 0
    ram_bytes: int = 0
    state: PipeState = PipeState.PENDING
    exception: BaseException | None = None
    start_time: float | None = None
    end_time: float | None = None

    @property
    def duration(self) -> float:
        if self.start_time is None:
            return 0.0
        return (self.end_time or time.time()) - self.start_time

    @property
    def items_per_second(self) -> float:
        return self.total_processed / self.duration if self.duration > 0 else 0.0

    @property
    def is_finished(self) -> bool:
        return self.state in (PipeState.COMPLETED, PipeState.FAILED, PipeState.ABORTED)

    @property
    def has_error(self) -> bool:
        return self.exception is not None or self.state is PipeState.FAILED

    @property
    def is_alive(self) -> bool:
        return self.state is PipeState.RUNNING

    def begin(self) -> None:
        self.state, self.start_time, self.end_time, self.exception = PipeState.RUNNING, time.time(), None, None
        self.total_processed = self.success_count = self.error_count = 0

    def finish(self, state: PipeState, exception: BaseException | None = None) -> None:
        if self.state is not PipeState.ABORTED:
            self.state, self.exception = state, exception
        self.end_time = time.time()

    @staticmethod
    def aggregate(reports: list[Report]) -> Report:
        """Sums of counters, first start, last end; failed if any failed, running while any runs."""
        out = Report()
        for r in reports:
            out.total_processed += r.total_processed
            out.success_count += r.success_count
            out.error_count += r.error_count
            out.ram_bytes += r.ram_bytes
            out.exception = out.exception or r.exception
        starts, ends = [r.start_time for r in reports if r.start_time], [r.end_time for r in reports if r.end_time]
        out.start_time = min(starts, default=None)
        states = {r.state for r in reports}
        if out.exception or PipeState.FAILED in states:
            out.state = PipeState.FAILED
        elif PipeState.ABORTED in states:
            out.state = PipeState.ABORTED
        elif reports and states == {PipeState.COMPLETED}:
            out.state = PipeState.COMPLETED
        elif states & {PipeState.RUNNING, PipeState.COMPLETED}:
            out.state = PipeState.RUNNING
        if reports and all(r.is_finished for r in reports):
            out.end_time = max(ends, default=None)
        return out

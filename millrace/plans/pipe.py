"""A pipe: source, hooks, model, hooks, and the two sinks, as one plan."""

from __future__ import annotations

import copy
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.model import STATUS, PipelineError, PipeState, Report, Status, enveloped, get_logger
from millrace.operators.hooks import Hook, apply_hooks
from millrace.operators.route import failed, succeeded
from millrace.operators.validate import Validator
from millrace.sinks.base import Sink
from millrace.sources.base import Source
from millrace.telemetry import Telemetry


class Pipe:
    """Nothing is read before start(); plan() shows what will run.

    Rows are evaluated once: they are observed, persisted below both sinks, and each sink
    takes its share. With no error sink there is one write, and nothing is persisted.
    """

    def __init__(
        self,
        source: Source,
        sink: Sink | None = None,
        error_sink: Sink | None = None,
        model: type | None = None,
        pre_hooks: list[Hook] | None = None,
        post_hooks: list[Hook] | None = None,
        *,
        prune_columns: bool = True,
        generate_ids: bool = True,
        positions: bool = False,
        include_errors: bool = False,
        on_hook_error: str = "raise",
        order_by_position: bool = False,
        native_validation: bool = True,
        logger=None,
        telemetry: Telemetry | None = None,
        spark: SparkSession | None = None,
    ):
        self.source, self.sink, self.error_sink, self.model = copy.copy(source), sink, error_sink, model
        self.prune_columns, self.native_validation = prune_columns, native_validation
        self.validator = Validator(model, native=native_validation) if model is not None else None
        self.pre_hooks = [*source.hooks(), *(pre_hooks or [])]
        self.post_hooks = [*(sink.hooks() if sink else []), *(error_sink.hooks() if error_sink else []), *(post_hooks or [])]
        if prune_columns and self.validator and not self.pre_hooks and not (error_sink is not None):
            self.source.require(self.validator.required_columns())
        self.generate_ids, self.positions, self.include_errors = generate_ids, positions or order_by_position, include_errors
        self.on_hook_error, self.order_by_position = on_hook_error, order_by_position
        self.logger, self.spark, self.telemetry = logger or get_logger(), spark, telemetry or Telemetry()
        self.report, self.committed, self.group = Report(), {}, f"pipe-{uuid.uuid4().hex}"
        self._thread: threading.Thread | None = None
        self._store: dict = {}

    def session(self) -> SparkSession:
        return self.spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def plan(self, raw: DataFrame | None = None) -> DataFrame:
        """The enveloped records after all hooks and validation; raw: records to take instead of the source's."""
        route = self.on_hook_error == "route"
        df = enveloped(self.source.frame(self.session()) if raw is None else raw, generate_ids=self.generate_ids, positions=self.positions)
        df = apply_hooks(df, self.pre_hooks, route_errors=route)
        df = self.validator.apply(df, once=bool(self.pre_hooks)) if self.validator else df
        df = apply_hooks(df, self.post_hooks, route_errors=route)
        return df.orderBy("_position") if self.order_by_position else df

    def process(self, raw: DataFrame | None = None, sinks: tuple[Sink | None, Sink | None] | None = None) -> tuple[int, int]:
        """Runs the plan and writes; returns the records that came out and those that failed."""
        sink, error_sink = sinks or (self.sink, self.error_sink)
        seen = Observation()
        is_failed = F.col(STATUS) == Status.FAILED.value
        df = self.plan(raw).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(is_failed).alias("failed"))
        # Sinks through which rows are streamed to the driver run no query that Spark observes.
        twice = (sink is not None and error_sink is not None) or not all(s.observes for s in (sink, error_sink) if s is not None)
        if twice:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if sink is not None:
                with self.telemetry.span("write", sink=type(sink).__name__):
                    self.committed = sink.write(succeeded(df))
            if error_sink is not None:
                with self.telemetry.span("write_errors", sink=type(error_sink).__name__):
                    error_sink.write(failed(df, include_errors=self.include_errors))
            if twice or not (sink or error_sink):
                total, bad = df.select(F.count(F.lit(1)), F.count_if(is_failed)).first()
                return total, bad
            return seen.get["total"], seen.get["failed"]
        finally:
            if twice:
                df.unpersist()

    # -- life cycle -------------------------------------------------------
    def _work(self) -> None:
        hooks = [*self.pre_hooks, *self.post_hooks]
        done: list[Hook] = []
        try:
            self.session().sparkContext.setJobGroup(self.group, "pipe", interruptOnCancel=True)
            for h in hooks:
                done.append(h)
                h.setup(self._store)
            with self.telemetry.span("pipe", group=self.group):
                total, bad = self.process()
            self.report.total_processed, self.report.error_count, self.report.success_count = total, bad, total - bad
            self.report.finish(PipeState.COMPLETED)
        except BaseException as e:
            self.report.finish(PipeState.FAILED, e)
        finally:
            for h in done:
                h.teardown(self._store)

    def start(self, wait: bool = False) -> None:
        if self._thread is not None and self._thread.is_alive():
            raise PipelineError("a pipe runs once at a time, and this one hasn't ended")
        self.report.begin()
        from pyspark import InheritableThread

        self._thread = InheritableThread(target=self._work)
        self._thread.start()
        if wait:
            self.wait()

    def wait(self, timeout: float | None = None) -> bool:
        """True if the run has ended, with its data written."""
        if self._thread is not None:
            self._thread.join(timeout)
        return self.report.is_finished

    def watch(self) -> Report:
        """The report; while the pipe runs, its total is the most records that one of its stages has written so far."""
        if self._thread is not None and self._thread.is_alive():
            context = self.session().sparkContext
            try:
                tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
                stages = {s for job in tracker.getJobIdsForGroup(self.group) for s in tracker.getJobInfo(job).stageIds}
                each = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s)]
                seen = max((max(x.outputRecords(), x.shuffleWriteRecords()) for x in each), default=0)
            except Py4JError:  # stages come and go
                seen = 0
            if not self.report.is_finished:
                self.report.total_processed = max(self.report.total_processed, seen)
        return self.report

    def shutdown(self, timeout: float = 5.0) -> None:
        """Cancels the pipe's jobs; what sinks haven't committed is left out."""
        if self._thread is not None and self._thread.is_alive():
            self.report.state = PipeState.ABORTED
            self.session().sparkContext.cancelJobGroup(self.group)
            self._thread.join(timeout)

    def run(self, wait: bool = True, timeout: float | None = None, on_report_update: Callable[[Report], None] | None = None, interval: float = 0.5) -> bool:
        """start(), and if wait is true watch until the end or the timeout; returns whether it has ended."""
        import time

        self.start()
        if not wait:
            return self.report.is_finished
        until = None if timeout is None else time.time() + timeout
        while not self.wait(interval if until is None else max(0.0, min(interval, until - time.time()))):
            if on_report_update:
                on_report_update(self.watch())
            if until is not None and time.time() >= until:
                return False
        if on_report_update:
            on_report_update(self.report)
        return True

    def __enter__(self) -> Pipe:
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_thread": None, "spark": None, "logger": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.logger = get_logger()

"""Many pipes at once, or one pipe in parts, with coordinators around them."""

from __future__ import annotations

import time
from collections.abc import Callable

from millrace.model import PipelineError, PipeState, Report, WorkerResult, get_logger
from millrace.plans.coordinators import CompositeCoordinator, Coordinator, MergeCoordinator, ShardingCoordinator
from millrace.plans.pipe import Pipe


class PipeManager:
    """Pipes run as concurrent Spark jobs of one session, which shares out the executors."""

    def __init__(self, pipes: list[Pipe], coordinators: list[Coordinator] | None = None):
        self.pipes, self.coordinator = pipes, CompositeCoordinator(coordinators or [])
        self.started = False
        self.logger = get_logger()

    @staticmethod
    def parallelize(pipe: Pipe, workers: int, *, merge: bool = True, coordinators: list[Coordinator] | None = None) -> PipeManager:
        """A manager of one pipe in `workers` parts of source and sink, merged to the sink's path if it is a file.

        Sources that Spark reads in parallel anyway come back whole; the data is then
        dealt to as many tasks. Hooks, model, error sink and settings stay the same.
        """
        own = pipe.sink.coordinator() if pipe.sink else None
        target = pipe.sink.path if pipe.sink else None
        chosen = [*(coordinators or []), *([own] if own else []), ShardingCoordinator()]
        split = CompositeCoordinator(chosen)
        sources = split.prepare_shards(pipe.source, workers)
        sinks = split.prepare_shards(pipe.sink, len(sources)) if pipe.sink else [None] * len(sources)
        errors = pipe.error_sink.split(len(sources)) if pipe.error_sink and len(sources) > 1 else [pipe.error_sink] * len(sources)
        if len(sources) == 1:
            sinks, errors = [pipe.sink], [pipe.error_sink]
        parts = []
        for source, sink, error in zip(sources, sinks, errors, strict=True):
            part = Pipe(
                source, sink, error, pipe.model, pipe.pre_hooks, pipe.post_hooks, generate_ids=pipe.generate_ids, positions=pipe.positions, prune_columns=pipe.prune_columns, native_validation=pipe.native_validation, include_errors=pipe.include_errors,
                on_hook_error=pipe.on_hook_error, order_by_position=pipe.order_by_position, logger=pipe.logger, telemetry=pipe.telemetry, spark=pipe.spark,
            )
            parts.append(part)
        if merge and len(sources) > 1 and target and not own and pipe.sink.single:
            chosen.append(MergeCoordinator(target))
            if pipe.error_sink is not None and pipe.error_sink.path and pipe.error_sink.single:
                chosen.append(_ErrorMerge(pipe.error_sink.path))
        return PipeManager(parts, chosen)

    def start(self) -> None:
        self.coordinator.on_start(self)
        for p in self.pipes:
            if self._stages(p):
                _stage_only(p)
            p.start()
        self.started = True

    def _stages(self, pipe: Pipe) -> bool:
        from millrace.plans.coordinators import DeltaCoordinator

        return any(isinstance(c, DeltaCoordinator) for c in self.coordinator.coordinators) and hasattr(pipe.sink, "stage")

    def wait(self, timeout: float | None = None) -> bool:
        until = None if timeout is None else time.time() + timeout
        return all([p.wait(None if until is None else max(0.0, until - time.time())) for p in self.pipes])

    def shutdown(self, timeout: float = 5.0) -> None:
        for p in self.pipes:
            p.shutdown(timeout)

    def run(self, wait: bool = True, timeout: float | None = None, on_report_update: Callable[[Report], None] | None = None, interval: float = 0.5) -> bool:
        """Runs all pipes, telling of their report each interval; then coordinators finish, or hear of the first failure, which is raised."""
        try:
            self.start()
            if not wait:
                return False
            until = None if timeout is None else time.time() + timeout
            while not self.wait(interval if until is None else max(0.0, min(interval, until - time.time()))):
                if on_report_update:
                    on_report_update(self.report)
                if until is not None and time.time() >= until:
                    return False
            if on_report_update:
                on_report_update(self.report)
            results = self.results()
            error = next((p.report.exception for p in self.pipes if p.report.exception), None)
            if error is not None:
                raise error
            self.coordinator.on_finish(self, results)
            return True
        except BaseException as e:
            self.coordinator.on_error(self, e)
            raise

    def results(self) -> list[WorkerResult]:
        return [
            WorkerResult(
                i, p.report.state is PipeState.COMPLETED, p.sink.path if p.sink else None,
                {"total": p.report.total_processed, "success": p.report.success_count, "error": p.report.error_count} | ({"staged": p.committed} if "adds" in p.committed else {}),
                None if p.report.exception is None else str(p.report.exception),
            )
            for i, p in enumerate(self.pipes)
        ]

    @property
    def report(self) -> Report:
        for p in self.pipes:
            p.watch()
        return Report.aggregate([p.report for p in self.pipes])

    @property
    def pipe_reports(self) -> list[Report]:
        if not self.started:
            raise PipelineError("no pipe runs before start()")
        return [p.report for p in self.pipes]

    def pipe_report(self, index: int) -> Report:
        if not 0 <= index < len(self.pipes):
            raise IndexError(f"pipe {index} is out of range")
        return self.pipe_reports[index]

    def __enter__(self) -> PipeManager:
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()


class _ErrorMerge(MergeCoordinator):
    def on_finish(self, manager: PipeManager, results: list[WorkerResult]) -> None:
        super().on_finish(manager, [WorkerResult(i, r.success, p.error_sink.path if p.error_sink else None) for i, (p, r) in enumerate(zip(manager.pipes, results, strict=True))])


def _stage_only(pipe: Pipe) -> None:
    """Lets the pipe's sink write files without a commit, which its coordinator makes for all."""
    import copy

    sink = copy.copy(pipe.sink)
    sink.write = sink.stage
    pipe.sink = sink

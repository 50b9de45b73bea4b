"""Spans of a run, if OpenTelemetry is installed; else nothing."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator


class Telemetry:
    """span(name, **attributes) around a piece of work; an exception inside is recorded and goes on."""

    def __init__(self, name: str = "millrace", enabled: bool = True):
        self.name, self.enabled = name, enabled

    def _tracer(self):
        if not self.enabled:
            return None
        try:
            from opentelemetry import trace
        except ImportError:
            return None
        return trace.get_tracer(self.name)

    @contextlib.contextmanager
    def span(self, name: str, **attributes) -> Iterator[None]:
        tracer = self._tracer()
        if tracer is None:
            yield
            return
        with tracer.start_as_current_span(name) as span:
            for k, v in attributes.items():
                span.set_attribute(k, v)
            yield

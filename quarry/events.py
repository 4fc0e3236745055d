"""Progress of a run: events on the driver, and spans, whose names Spark's own event log and pages show on their jobs."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("quarry")

KINDS = (
    "run_started", "pass_started", "answered", "pass_finished", "aggregated", "run_finished", "step_started", "step_finished", "retried", "failed", "debug",
)


@dataclass(frozen=True)
class Event:
    kind: str
    values: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown event {self.kind}")


def to_console(e: Event) -> None:
    print(f"{e.kind}: " + ", ".join(f"{k}={v}" for k, v in e.values.items()))


def silent(e: Event) -> None:
    pass


def to_log(e: Event) -> None:
    (log.error if e.kind == "failed" else log.info)("%s %s", e.kind, e.values)


class Progress:
    """Sends events to a handler, which may be set again at any time."""

    def __init__(self, handler: Callable[[Event], None] = to_log):
        self.handler = handler

    def emit(self, kind: str, **values: Any) -> None:
        self.handler(Event(kind, values))

    @contextmanager
    def span(self, spark: SparkSession, name: str, **values: Any) -> Iterator[None]:
        """Names the jobs that run within, and tells how long all of it took, failures too."""
        began = time.monotonic()
        spark.sparkContext.setJobDescription(f"quarry: {name}")
        try:
            yield
        finally:
            spark.sparkContext.setJobDescription(None)
            self.emit("debug", span=name, took_ms=int((time.monotonic() - began) * 1000), **values)

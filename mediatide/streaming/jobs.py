"""Long jobs one at a time: a second run of a kind is refused while the first goes on, and a run can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext


class AlreadyRunning(RuntimeError):
    """A job of this kind is under way."""


class Jobs:
    """The runs of one driver, by kind."""

    def __init__(self, sc: SparkContext):
        self._sc, self._lock, self._groups = sc, threading.Lock(), {}

    @contextmanager
    def only(self, kind: str) -> Iterator[str]:
        """All Spark jobs started inside are of this run; :class:`AlreadyRunning` if there is one of the kind."""
        group = f"{kind}-{uuid.uuid4().hex}"
        with self._lock:
            if kind in self._groups:
                raise AlreadyRunning(kind)
            self._groups[kind] = group
        try:
            self._sc.setJobGroup(group, kind, interruptOnCancel=True)
            yield group
        finally:
            self._sc.setLocalProperty("spark.jobGroup.id", None)
            with self._lock:
                del self._groups[kind]

    def running(self) -> list[str]:
        with self._lock:
            return sorted(self._groups)

    def cancel(self, kind: str) -> bool:
        """Cancel the run of a kind; whether there was one. What it had not written by then is not written."""
        with self._lock:
            group = self._groups.get(kind)
        if group:
            self._sc.cancelJobGroup(group)
        return group is not None

"""Watching streams: progress counts, and a warning when one stands still."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Watch(StreamingQueryListener):
    """Counts triggers and rows of every query; ``idle(now)`` names those without progress for longer than the threshold."""

    def __init__(self, threshold_s: float = 300.0, warn: Callable[[str, float], None] | None = None):
        self.threshold_s, self.warn = threshold_s, warn
        self.seen: dict[str, float] = {}
        self.triggers: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.seen[str(event.runId)] = time.time()

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.runId)
        with self.lock:
            self.seen[key] = time.time()
            self.triggers[key] = self.triggers.get(key, 0) + 1
            self.rows[key] = self.rows.get(key, 0) + int(event.progress.numInputRows or 0)

    def onQueryIdle(self, event) -> None:
        with self.lock:
            self.seen[str(event.runId)] = time.time()

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.seen.pop(str(event.runId), None)

    def idle(self, now: float | None = None) -> list[str]:
        now = time.time() if now is None else now
        with self.lock:
            late = {k: now - t for k, t in self.seen.items() if now - t > self.threshold_s}
        if self.warn:
            for k, s in late.items():
                self.warn(k, s)
        return sorted(late)

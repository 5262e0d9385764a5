"""Latencies of the last requests of a process."""

from __future__ import annotations

import time
from collections import deque
from contextlib import contextmanager
from threading import Lock

import numpy as np


class LatencyWindow:
    """Milliseconds of the last ``size`` requests; safe for threads."""

    def __init__(self, size: int = 1024):
        self._kept: deque[float] = deque(maxlen=size)
        self._lock, self.total = Lock(), 0

    def record(self, ms: float) -> None:
        with self._lock:
            self._kept.append(ms)
            self.total += 1

    @contextmanager
    def timed(self):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record((time.perf_counter() - began) * 1000)

    def snapshot(self) -> dict[str, float | int | None]:
        """Counts and p50, p95, p99, largest and mean; None without requests."""
        with self._lock:
            kept, total = np.array(self._kept), self.total
        if not len(kept):
            return {"total": total, "kept": 0} | dict.fromkeys(("p50", "p95", "p99", "max", "mean"))
        p50, p95, p99 = np.percentile(kept, [50, 95, 99])
        return {"total": total, "kept": len(kept), "p50": float(p50), "p95": float(p95), "p99": float(p99), "max": float(kept.max()), "mean": float(kept.mean())}

    def reset(self) -> None:
        with self._lock:
            self._kept.clear()
            self.total = 0

"""A registry of running tasks that forgets them after a while, and the re-indexing of what a watch reports."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from orrery.operators import extract, store

STATES = ("working", "completed", "failed", "cancelled")


class TaskRegistry:
    """Tasks by id with state, message and result; finished ones are forgotten `ttl` seconds after they ended."""

    def __init__(self, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self._lock = threading.Lock()
        self._tasks: dict[str, dict] = {}

    def _purge(self) -> None:
        now = self.clock()
        for k in [k for k, t in self._tasks.items() if t["ended"] is not None and now - t["ended"] >= self.ttl]:
            del self._tasks[k]

    def start(self, message: str = "") -> str:
        with self._lock:
            self._purge()
            key = uuid.uuid4().hex
            self._tasks[key] = {"state": "working", "message": message, "result": None, "ended": None}
            return key

    def finish(self, key: str, state: str = "completed", result=None) -> bool:
        """False if the task is unknown or has ended before."""
        if state not in STATES[1:]:
            raise ValueError(state)
        with self._lock:
            task = self._tasks.get(key)
            if task is None or task["ended"] is not None:
                return False
            task.update(state=state, result=result, ended=self.clock())
            return True

    def get(self, key: str) -> dict | None:
        with self._lock:
            self._purge()
            task = self._tasks.get(key)
            return {k: v for k, v in task.items() if k != "ended"} if task else None

    def states(self) -> dict[str, str]:
        with self._lock:
            self._purge()
            return {k: t["state"] for k, t in self._tasks.items()}


class CacheCounter:
    """Hits and misses of a cache."""

    def __init__(self):
        self.hits = self.misses = 0

    def rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


def reindex(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the changed files (file_path, language, content) read again.

    Their symbols and the edges that touch them go; what they hold now comes in, and their references are resolved over
    all symbols. `nodes` has the columns of `extract.nodes_of`, `edges` source_id, target_id and type.
    """
    found = extract.extract(changed)
    new = extract.nodes_of(found)
    kept, _ = store.delete_files(nodes, edges, changed)
    whole = kept.select(*nodes.columns).unionByName(new.select(*nodes.columns))
    return store.replace_files(nodes, edges, new, extract.reference_edges(found, whole), changed)

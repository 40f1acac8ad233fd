"""What a Python worker keeps from one task to the next.

Functions travel to the workers by value, with fresh globals for each task; a module of its own name outlives them.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that goes to Python or comes back; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this worker first asked for ``key``."""
    held = sys.modules.setdefault("parley_worker_kept", types.ModuleType("parley_worker_kept")).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Arrow batches of ``BATCH_BYTES`` to Python, where Spark's default is 10,000 rows or 64 MiB.

    A batch of texts stands several times in the executor's buffers and the worker's arrays, in each task that runs. Frames are planned when
    they are written, so the setting stays; results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "malloc_trim"):  # other C libraries have no such call
        system.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with free memory handed back to the system at the end of each task.

    Workers live on between tasks and stages; what their allocators hold would stand beside the JVM's heap in stages that use no Python at all.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


class Memory:
    """The latest values by key, between ``limit`` and twice as many: the older half goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def rows(self, keys: list[bytes]) -> list:
        """The values of ``keys``, None where there is none."""
        new, old = self.new, self.old
        rows = [new.get(key) for key in keys]
        for k, row in enumerate(rows):
            if row is None and (row := old.get(keys[k])) is not None:
                rows[k] = row
                self.put(keys[k], row)
        return rows

    def put(self, key: bytes, value: Any) -> None:
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        self.new[key] = value

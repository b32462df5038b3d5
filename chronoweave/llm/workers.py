"""Memory of Python workers, which live on after a task."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

#: For tables whose rows hold texts or sets: a worker gets so many rows at a time, not 10,000.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def give_back() -> None:
    """What a task no longer needs goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

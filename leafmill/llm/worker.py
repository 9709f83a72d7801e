"""What a Python worker keeps from one task to the next: one operator's state at a time."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa

#: Bytes of an Arrow batch that a task works on at a time, and sends back at a time.
SLICE_BYTES = 4 << 20

_state: dict = {}


def hold(key, make):
    """The state under a key, made at the first call; whatever another operator has left goes."""
    if key not in _state:
        release()
        _state[key] = make()
    return _state[key]


def release() -> None:
    """Drops kept states, and gives memory back to the system: workers outlive the operator they first ran."""
    if _state:
        _state.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives the memory of what is gone back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def slices(batches):
    """Arrow batches in slices of about SLICE_BYTES, a row at least; pandas frames as they are.

    Spark's batches count rows, whatever their texts weigh, and hold a whole task's rows as
    a rule; what is made of a slice goes back before the next one is taken.
    """
    for batch in batches:
        if not isinstance(batch, pa.RecordBatch) or batch.nbytes <= SLICE_BYTES:
            yield batch
            continue
        n = max(1, batch.num_rows * SLICE_BYTES // batch.nbytes)
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def tidy(run):
    """A task's function that begins without kept states, works on slices of batches, and leaves no memory to a worker that then waits, as it may for long, beside the ones at work."""

    @wraps(run)
    def task(batches):
        release()
        yield from run(slices(batches))
        trim()

    return task


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: a column of their own, or a field of the row that is carried along."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")

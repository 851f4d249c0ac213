"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, names: list[str], schema: str, fn: Callable[..., Iterator[tuple]], slice_rows: int = 1_000) -> DataFrame:
    """Run ``fn(columns...)`` on slices of each Arrow batch and collect the tuples that it yields.

    Only ``names`` reach Python, so columns of other names can neither clash nor cost anything.
    ``fn`` gets one Python list for each name, of ``slice_rows`` rows at most.
    """
    source = df.select(*[df[n] for n in names])
    empty = df.sparkSession.createDataFrame([], schema)
    fields = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, slice_rows):
            rows = list(fn(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)
        trim()

    return source.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], slice_rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for all rows of a batch become Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            yield batch.slice(at, slice_rows)


def trim() -> None:
    """Give free memory back to the system; allocators keep it for a worker's next task otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Keeps Python's cycle collector off, as many small lists are made without cycles, and runs it once after.

    Workers serve one task after another; with the collector off for good, what one task left in
    cycles would stay for all the others.
    """
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()


_BUILT: dict[object, object] = {}


def built(token: object, build: Callable[[], object]):
    """What ``build`` makes, kept by a worker until another token comes; one such thing is kept at a time."""
    if token not in _BUILT:
        forget()
        _BUILT[token] = build()
    return _BUILT[token]


def forget() -> None:
    """Drop what an earlier stage left in this worker, and give its memory back to the system."""
    if _BUILT:
        _BUILT.clear()
        gc.collect()
        trim()


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

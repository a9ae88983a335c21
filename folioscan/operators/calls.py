"""Calls of a service for each row, a bounded number of them at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: Calls of one task that are under way at once.
IN_FLIGHT = 8
#: Code points of an error that are kept.
ERROR_CHARS = 500


def windowed(values: Iterable, call: Callable, pool: ThreadPoolExecutor, in_flight: int) -> Iterator[tuple[object, str | None]]:
    """(result, error) for each value, in order. While in_flight calls are under way no further value is taken."""
    waiting: deque[Future | None] = deque()

    def settled(f: Future | None) -> tuple[object, str | None]:
        if f is None:
            return None, None
        try:
            return f.result(), None
        except Exception as e:  # noqa: BLE001 - a row keeps what its call said
            return None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]

    for value in values:
        if len(waiting) == in_flight:
            yield settled(waiting.popleft())
        waiting.append(None if value is None else pool.submit(call, value))
    while waiting:
        yield settled(waiting.popleft())


def call_each(rows: DataFrame, column: str, call: Callable, result: DataType, in_flight: int = IN_FLIGHT) -> DataFrame:
    """rows with `result`, what call gives for the column's value, and `error`, what it raised, if it did.

    A task has at most in_flight calls under way; a full window stops the reading of its input, and with it the stage
    before, so that no queue grows. Rows keep their order and failing calls fail their row only. Nulls aren't called:
    result and error are null. A task that is run again calls again, so calls must bear repetition. Timeouts are the
    call's own."""
    taken = {"result", "error"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns of the answer: {sorted(taken)}")
    if in_flight < 1:
        raise ValueError("at least one call must be allowed")
    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: deque[pa.RecordBatch] = deque()  # those whose calls aren't all settled

        def values() -> Iterator:
            for b in batches:
                if len(b):
                    read.append(b)
                    yield from (v.as_py() for v in b.column(column))

        pool = ThreadPoolExecutor(in_flight)
        try:
            out: list[tuple[object, str | None]] = []
            for answer in windowed(values(), call, pool, in_flight):
                out.append(answer)
                if len(out) == len(read[0]):
                    b = read.popleft()
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in out], kind), pa.array([e for _, e in out], pa.string())], names=[*b.schema.names, "result", "error"])
                    out = []
        finally:
            pool.shutdown(cancel_futures=True)

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("result", result), StructField("error", StringType())]))

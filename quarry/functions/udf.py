"""Arrow UDFs over whole columns from functions of single values."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_BYTES = 2 << 20
#: So much of a batch is in Python at a time: values and results as objects take many times the bytes of their columns.
SLICE_BYTES, SLICE_ROWS = 256 << 10, 1024


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller.

    A batch is held by the JVM, on its way, and by the Python worker, beside its output; Spark's own bound of 64 MB
    would hold whole input splits several times in every running task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """The rows of a batch, some at a time."""
    rows = len(columns[0])
    step = max(1, min(SLICE_ROWS, rows * SLICE_BYTES // max(1, sum(c.nbytes for c in columns))))
    for at in range(0, rows, step):
        yield [c.slice(at, step) for c in columns]


def _column(call: Callable[..., pa.Array], kind: T.DataType, args: list[Column]) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        bounded_batches(spark)
    return F.arrow_udf(call, kind)(*args)


def per_value(returns: T.DataType | str) -> Callable[[Callable[..., Any]], Callable[..., Column]]:
    """An Arrow UDF that applies a function to each row; any null argument gives null.

    Batches travel as Arrow columns, so a value costs one Python call and no pickling.
    """

    def wrap(f: Callable[..., Any]) -> Callable[..., Column]:
        @functools.wraps(f)
        def column(*args) -> Column:
            kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
            return _column(_batched(f, to_arrow_type(kind)), kind, [a if isinstance(a, Column) else F.lit(a) for a in args])

        column.of = f  # the function of one row, for tests and other functions
        return column

    return wrap


def per_batch(returns: T.DataType | str) -> Callable[[Callable[[pa.Array], pa.Array]], Callable[..., Column]]:
    """An Arrow UDF of one column from a function of many rows at once; nulls are the function's to handle."""

    def wrap(f: Callable[[pa.Array], pa.Array]) -> Callable[..., Column]:
        @functools.wraps(f)
        def column(arg: Column) -> Column:
            kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

            def call(a: pa.Array) -> pa.Array:
                parts = [f(part) for (part,) in _slices((a,))]
                return pa.concat_arrays(parts) if parts else f(a)

            return _column(call, kind, [arg])

        column.of = f
        return column

    return wrap


def value_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column as one array, and where each row begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)), offsets


def _batched(f: Callable[..., Any], kind: pa.DataType) -> Callable[..., pa.Array]:
    def part(columns: list[pa.Array]) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in row else f(*row) for row in rows], kind)

    def run(*columns: pa.Array) -> pa.Array:
        parts = [part(some) for some in _slices(columns)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # The signature tells Spark that these are Arrow columns.
    if f.__code__.co_argcount == 1:

        def call(a: pa.Array) -> pa.Array:
            return run(a)
    elif f.__code__.co_argcount == 2:

        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    elif f.__code__.co_argcount == 3:

        def call(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)
    else:

        def call(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            return run(a, b, c, d)

    return call

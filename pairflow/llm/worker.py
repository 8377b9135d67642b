"""Objects that a Python worker builds once and keeps for its later tasks (automata, tokenizers)."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HOLDER = "_pairflow_worker_objects"


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The worker's object of that key. It hangs on a module of its own, as functions that are shipped by
    value get new globals in every task."""
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def latest(kind: str, name: str, make: Callable[[], object]) -> object:
    """As kept, for objects that belong to one run: the worker holds one of a kind, the last run's."""
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
    own = holder.__dict__.get(kind)
    if own is None or own[0] != name:
        holder.__dict__.pop(kind, None)
        own = holder.__dict__[kind] = (name, make())
    return own[1]


def trim() -> None:
    """Give freed memory back at the end of a task: workers stay alive beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs run inside hand texts to Python in batches of so many rows, which bounds the buffers on both sides."""
    before = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, before) if before > 0 else rows)):
        yield


@contextlib.contextmanager
def tasks_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside read files in tasks of so many bytes."""
    with _set(spark, "spark.sql.files.maxPartitionBytes", str(size)):
        yield


@contextlib.contextmanager
def row_groups_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside write Parquet in row groups of so many bytes."""
    with _set(spark, "parquet.block.size", str(size)):
        yield


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside delete their shuffle files as they end, not when the driver collects its garbage: for steps that
    store their result and are not run again."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)

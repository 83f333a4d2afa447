"""Sends the package to the executors' Python workers, which may not have it on their path."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file of the session's application, once."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if context.applicationId in _SENT or not root.is_dir():
        return
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ontomill-")), "ontomill_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(to)
    _SENT.add(context.applicationId)


def give_back() -> None:
    """Returns free memory to the system; a worker process is used again by later stages, beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_rows(df: DataFrame, rows: Callable, schema) -> DataFrame:  # noqa: ANN001
    """``df.mapInArrow(rows, schema)`` with the package at hand on the workers, which give memory back after each task."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return df.mapInArrow(task, schema)

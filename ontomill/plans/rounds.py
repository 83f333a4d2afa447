"""Helpers for plans that run in rounds: durable cuts of the lineage, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``, or the one that its context was given.

    Only a local session that names none (tests, a laptop) gets a temporary folder; a cluster's executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ontomill-checkpoint-"))
    return named or context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of written tables whose readers are done, by the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation of earlier rounds."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet: computed once (a checkpoint computes its last stage twice), and read by column."""
    at = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a task that sorts or aggregates what it holds.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by keys over as many tasks as its rows ask for: an aggregate over them takes the same memory at any size."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, bound_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` times ``row_bytes`` is within the bound, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= bound_bytes else df

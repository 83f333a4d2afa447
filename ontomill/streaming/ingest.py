"""Assertions from a stream into a graph's tables, each once, and windowed counts with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ontomill.sources.graphs import TABLES

DELTA = "kind string, a string, b string, c string, d string, at timestamp"
#: Table of each kind of delta and its columns' names.
KINDS = {"type": ("class_assertion", ("cls", "ind")), "link": ("obj_assertion", ("p", "s", "o")), "value": ("data_assertion", ("p", "s", "lex", "dt"))}


def read_deltas(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of JSON lines ``kind, a, b, c, d, at`` from a folder."""
    return spark.readStream.schema(DELTA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(deltas: DataFrame, folder: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Appends deltas to Parquet tables below ``folder``, equal ones within the watermark once.

    A batch is written under its own number, so a batch that is run again after a failure replaces what it wrote before.
    """
    once = deltas.withWatermark("at", late).dropDuplicatesWithinWatermark(["kind", "a", "b", "c", "d"])

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for kind, (table, names) in KINDS.items():
            rows = held.where(F.col("kind") == kind).select(*[F.col(x).alias(n) for x, n in zip("abcd", names, strict=False)])
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
        held.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that ``ingest`` wrote."""
    return {table: spark.read.schema(f"{TABLES[table]}, batch long").parquet(f"{folder}/{table}").drop("batch").distinct() for table, _ in KINDS.values()}


def counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by window and a column; works on streams, where late rows beyond the watermark are left out, and on tables."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")

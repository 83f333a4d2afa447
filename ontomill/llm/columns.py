"""Shared column and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.plans.rounds import maybe_broadcast

#: The packed row; a struct keeps columns of any name apart from the operators' own.
ROW = "__row"


def text_of(name: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """One struct column with the whole row, and the operator's own columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(k) for k, c in own.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that ``packed`` took, with their own columns alone."""
    return df.select(f"{ROW}.*")


def without(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` but those marked (``id2, sha2, again``); where ``again`` holds, one of the repeated rows stays.

    That is the one whose columns come first as JSON, so that a task that runs again chooses the same.
    """
    rows = packed(docs, id=F.col(f"`{id_col}`"), sha=F.sha2(text_of(text_col), 256))
    on = F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2"))
    out = unpacked(rows.join(maybe_broadcast(marked.select("id2", "sha2"), marked.count(), 160), on, "left_anti"))
    again = marked.where("again").select("id2", "sha2")
    if again.isEmpty():
        return out
    once = rows.join(again, on, "left_semi").groupBy("id", "sha").agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW))
    return out.unionByName(unpacked(once))


def string_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string of an Arrow array; null gives empty."""
    return [b"" if x is None else x for x in array.cast(pa.large_binary()).to_pylist()]


def crc32_hex_mod4(name: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 4; null where the id is null."""
    return F.crc32(F.col(f"`{name}`").cast("string").cast("binary")) % 4


def uint64_to_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)

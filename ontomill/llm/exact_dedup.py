"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a text is a pair of polynomials over its UTF-8 bytes, each modulo a prime below 2**31. It is composable:
``print(a + b) = print(a) * base**len(b) + print(b)``, so chunks are hashed on their own, in parallel where a document is
huge, and combined by that length-shifted arithmetic. Rows of equal length and fingerprints are candidates only: their texts
are then compared chunk by chunk, and a text that differs from its group's representative leaves the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import string_bytes, text_of, without
from ontomill.plans.rounds import durable, maybe_broadcast
from ontomill.plans.ship import arrow_rows

#: Moduli (primes below 2**31) and bases of the two polynomials.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 742938285)
CHUNK = 1 << 16
HUGE = 1 << 20


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """``base**(n-1) .. base**0`` modulo ``modulus``."""
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def chunk_print(data: np.ndarray, tables: list[np.ndarray]) -> tuple[int, ...]:
    """Polynomials of one chunk of at most ``CHUNK`` bytes; a byte counts one more than its value, so leading zeros count."""
    wide = data.astype(np.uint64) + np.uint64(1)
    return tuple(int(wide @ t[len(t) - len(wide) :]) % m for t, m in zip(tables, MODULI, strict=True))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
    """The print of a concatenation from the prints of its parts."""
    return tuple((a * pow(base, right_bytes, m) + b) % m for a, b, base, m in zip(left, right, BASES, MODULI, strict=True))


def text_print(data: bytes, tables: list[np.ndarray], chunk: int = CHUNK) -> tuple[int, ...]:
    raw, out = np.frombuffer(data, np.uint8), (0,) * len(MODULI)
    for at in range(0, len(raw), chunk):
        part = raw[at : at + chunk]
        out = combine(out, chunk_print(part, tables), len(part))
    return out


def _tables() -> list[np.ndarray]:
    return [powers(b, m, CHUNK) for b, m in zip(BASES, MODULI, strict=True)]


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; it is replaced by their two prints."""
    tables = _tables()
    for batch in batches:
        prints = [text_print(x, tables) for x in string_bytes(batch.column(batch.num_columns - 1))]
        own = [pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "f1", "f2"])


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE, chunk_bytes: int = CHUNK) -> DataFrame:
    """``id, sha, n_bytes, f1, f2`` of every row.

    Texts of more than ``huge_bytes`` are cut into chunks that are dealt over all tasks, hashed there and combined in order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).withColumn("n_bytes", F.octet_length("t").cast("long"))
    keyed = rows.select("id", F.sha2("t", 256).alias("sha"), "n_bytes", "t")
    small = arrow_rows(keyed.where(F.col("n_bytes") <= huge_bytes), _print_rows, f"id {kind}, sha string, n_bytes long, f1 long, f2 long")
    large = keyed.where(F.col("n_bytes") > huge_bytes).withColumn("b", F.col("t").cast("binary"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(chunk_bytes).cast("long"))
    chunks = large.select("id", "sha", "n_bytes", "b", F.explode(starts).alias("at"))
    chunks = chunks.select("id", "sha", "n_bytes", "at", F.expr(f"substring(b, cast(at + 1 as int), {chunk_bytes})").alias("part"))
    # the chunk travels, not the text; chunks of equal rows are equal, and count once
    chunks = chunks.repartition(F.col("sha"), F.col("at"))
    hashed = arrow_rows(chunks, _chunk_rows, f"id {kind}, sha string, n_bytes long, at long, len long, h1 long, h2 long, s1 long, s2 long")
    whole = hashed.groupBy("id", "sha", "n_bytes").agg(F.array_sort(F.collect_set(F.struct("at", "h1", "h2", "s1", "s2"))).alias("parts"), F.sum((F.col("at") == 0).cast("int")).alias("rows"))
    joined = [_joined(i, m).alias(f"f{i}") for i, m in zip((1, 2), MODULI, strict=True)]
    whole = whole.select("id", "sha", "n_bytes", *joined, F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_")).drop("_")
    return small.unionByName(whole)


def _joined(i: int, modulus: int) -> Column:
    """Polynomial ``i`` of a whole text from its ordered chunks: shift what is there by the chunk's length, add the chunk."""
    m = F.lit(modulus).cast("long")
    return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: F.pmod(F.pmod(acc * p[f"s{i}"], m) + p[f"h{i}"], m))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds chunks; it is replaced by length, prints and the shifts that a chunk of that length makes."""
    tables = _tables()
    for batch in batches:
        parts = [np.frombuffer(x, np.uint8) for x in batch.column(batch.num_columns - 1).to_pylist()]
        found = [(len(p), *chunk_print(p, tables), *(pow(b, len(p), m) for b, m in zip(BASES, MODULI, strict=True))) for p in parts]
        own = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "len", "h1", "h2", "s1", "s2"])


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE, key: tuple[Column, ...] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, sha``.

    Rows are equal if their texts are, byte for byte; null counts as empty. The largest id stays (a null id counts as least);
    of repeated rows with that id exactly one is kept. An empty table gives an empty result; other columns are not looked at.
    ``key`` replaces the fingerprints (for tests of collisions).
    """
    key = key or (F.col("n_bytes"), F.col("f1"), F.col("f2"))
    own = [f"k{i}" for i in range(len(key))]
    p = prints(docs, id_col, text_col, huge_bytes)
    p = durable(p.select("id", "sha", *[c.alias(k) for c, k in zip(key, own, strict=True)], F.monotonically_increasing_id().alias("tag")))
    groups = durable(p.groupBy(*own).agg(F.count("*").alias("n"), F.max(F.struct("id", "tag")).alias("top")).where("n > 1"))
    differ = durable(_mismatches(docs, p, groups, own, id_col, text_col))
    if differ.isEmpty():
        p = p.withColumn("cls", F.lit(""))
    else:  # a collision: the differing texts form classes of their own
        marked = differ.distinct().withColumn("cls", F.col("sha")).select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "cls")
        p = p.join(marked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")), "left").drop("id2", "sha2").withColumn("cls", F.coalesce("cls", F.lit("")))
        groups = durable(p.groupBy(*own, "cls").agg(F.count("*").alias("n"), F.max(F.struct("id", "tag")).alias("top")).where("n > 1"))
    if "cls" not in groups.columns:
        groups = groups.withColumn("cls", F.lit(""))
    joined = p.join(groups, [*own, "cls"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id"))
    kept = F.col("n").isNull() | (F.col("top.tag") == F.col("tag"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "sha")


def _mismatches(docs: DataFrame, p: DataFrame, groups: DataFrame, own: list[str], id_col: str, text_col: str, per_salt: int = 256, chunk_bytes: int = CHUNK) -> DataFrame:
    """``id, sha`` of rows whose text differs from that of the row that stands for their group.

    A group is dealt over as many salts as it needs for ``per_salt`` rows each, and its representative goes to each of them.
    Texts travel and are compared in chunks: a chunk meets its representative's chunk of the same place, however long the text.
    """
    salts = F.ceil(F.col("n") / per_salt).cast("int")
    members = p.join(groups, own).select("id", "sha", "tag", *own, salts.alias("salts"), F.col("top").alias("top"))
    members = durable(members.select("id", "sha", *own, "salts", F.pmod(F.xxhash64("tag"), F.col("salts")).cast("int").alias("salt"), (F.col("top.tag") == F.col("tag")).alias("first")))
    rows = members.count()
    wanted = members.select(F.col("id").alias("id2"), F.col("sha").alias("sha2")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).withColumn("sha", F.sha2("t", 256))
    on = F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2"))
    texts = texts.join(maybe_broadcast(wanted, rows, 160), on, "left_semi").withColumn("b", F.col("t").cast("binary"))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(chunk_bytes))
    chunks = texts.select("id", "sha", "b", F.octet_length("b").alias("n"), F.explode(starts).alias("at"))
    chunks = chunks.select("id", "sha", "n", "at", F.expr(f"substring(b, at + 1, {chunk_bytes})").alias("part"))
    chunks = chunks.dropDuplicates(["id", "sha", "at"]) if _repeats(members) else chunks
    cand = members.join(chunks.withColumnsRenamed({"id": "id2", "sha": "sha2"}), on).drop("id2", "sha2")
    rep = cand.where("first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*own, "salt", "at", F.col("n").alias("rep_n"), F.col("part").alias("rep"))
    pairs = cand.where("not first").select("id", "sha", *own, "salt", "at", "n", "part").join(rep, [*own, "salt", "at"], "left")
    return pairs.where("rep is null or n <> rep_n or part <> rep").select("id", "sha").distinct()


def _repeats(members: DataFrame) -> bool:
    """Whether some row stands in the table more than once, id and text alike."""
    return not members.groupBy("id", "sha").count().where("count > 1").isEmpty()


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE) -> DataFrame:
    """The rows of ``docs``, one of each class of equal texts (the largest id), with their columns as they were.

    Of repeated rows with that id and text the one whose columns come first as JSON stays.
    """
    classes = durable(duplicate_classes(docs, id_col, text_col, huge_bytes))
    # a key that is both kept and dropped is a repeated row: one of its rows stays
    gone = classes.groupBy("id", "sha").agg(F.max("kept").alias("stays"), F.min("kept").alias("all_stay")).where("not all_stay")
    gone = durable(gone.select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), F.col("stays").alias("again")))
    return without(docs, gone, id_col, text_col)

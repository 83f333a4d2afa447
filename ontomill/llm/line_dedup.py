"""Boilerplate lines by site-relative frequency, in DataFrame operations alone.

For each host, the pages that hold a line are counted and divided by the host's pages; a line above the boilerplate ratio is
dropped from that host's pages. A host has at most (lines of a page) / ratio such lines, so a host's list is small whatever
the number of its pages; counting combines on the map side, so a hot host or line costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import ROW, packed, text_of
from ontomill.plans.rounds import durable, maybe_broadcast


def _hashes(line: Column) -> tuple[Column, Column]:
    """128 bits of a line, as two hashes with different seeds."""
    return F.xxhash64(line), F.xxhash64(line, F.lit(1))


def _host_key(host: Column) -> Column:
    """Null hosts are a host of their own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """``host, bad``: of each host with such lines, the hashes of those on more than ``ratio`` of its pages and on ``min_pages`` at least.

    A page counts once for a line, however often it repeats it. Lines of blanks are never boilerplate.
    """
    rows = docs.select(_host_key(host).alias("host"), text_of(text_col).alias("t"))
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    line = rows.select("host", F.explode(F.array_distinct(_lines(F.col("t")))).alias("line")).where("trim(line) <> ''")
    h1, h2 = _hashes(F.col("line"))
    counts = line.select("host", h1.alias("h1"), h2.alias("h2")).groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = durable(pages)
    bad = counts.join(maybe_broadcast(hosts, hosts.count(), 100), "host").where(F.col("n") > ratio * F.col("pages"))
    return bad.groupBy("host").agg(F.collect_list("h1").alias("h1s"), F.collect_list(F.struct("h1", "h2")).alias("bad"))


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """``docs`` packed as a struct, with ``n_lines``, ``n_dropped`` and the ``cleaned`` text.

    Null text counts as empty, which is one empty line. Every line above the ratio goes, at each of its places; the others
    stay in order. Rows stay as they are in number; an empty table gives an empty result.
    """
    bad = durable(boilerplate(docs, host, text_col, ratio, min_pages))
    listed = bad.agg(F.count("*"), F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()
    rows = packed(docs, host=_host_key(host), lines=_lines(text_of(text_col)))
    joined = rows.join(maybe_broadcast(bad, 1, 24 * listed[1] + 100 * listed[0]), "host", "left")

    def stays(x: Column) -> Column:
        h1, h2 = _hashes(x)
        return ~(F.array_contains("h1s", h1) & F.array_contains("bad", F.struct(h1.alias("h1"), h2.alias("h2"))))

    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    out = joined.select(ROW, "lines", kept.alias("kept"))
    return out.select(ROW, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("cleaned"))

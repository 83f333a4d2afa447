"""Graphs made incomplete or inconsistent on purpose, the same for the same seed.

What is picked follows a hash of the row and the seed, so a pick needs no order of input. An exact number is picked by the
value that the hash of the last picked row has: rows are counted by the hash's leading bits, then only the rows of the one
range in which the number is reached are counted by the next bits, so no task sorts or holds what is picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.plans.rounds import durable
from ontomill.sources.graphs import TripleGraph

#: Bits of the hash that one count looks at.
BITS = 12


def hash_of(columns: list[str], seed: int) -> Column:
    """The first 60 bits of MD5 of the seed and the columns as JSON (nulls kept apart from texts)."""
    told = F.to_json(F.array(F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def least(df: DataFrame, k: int, columns: list[str], seed: int) -> DataFrame:
    """The ``k`` rows of least hash; ties of 60 bits of hash stay together, and the rows must be distinct in ``columns``."""
    if k <= 0:
        return df.limit(0)
    h = hash_of(columns, seed)
    low, bits, left = 0, 60, k
    while bits:
        bits -= BITS
        at = F.shiftright(h - low, bits).alias("at")
        inside = (h >= low) & (h < low + (1 << (bits + BITS)))
        for r in sorted(df.where(inside).groupBy(at).count().collect()):
            if left <= r["count"]:
                low += r["at"] << bits
                break
            left -= r["count"]
        else:
            return df  # there are no more than that
    return df.where(h <= low)


def picked(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """``int(n * rate / 100)`` of the distinct rows, by least hash."""
    rows = durable(df.distinct())
    return least(rows, int(rows.count() * rate / 100), rows.columns, seed)


def without_assertions(graph: TripleGraph, rate: float, seed: int = 1) -> TripleGraph:
    """Without a share, in per cent, of all assertions of classes and properties."""
    a, o, d = (graph.table(n) for n in ("class_assertion", "obj_assertion", "data_assertion"))
    null = F.lit(None).cast("string")
    every = a.select(F.lit("c").alias("t"), F.col("cls").alias("x"), F.col("ind").alias("y"), null.alias("z"), null.alias("w"))
    every = every.unionAll(o.select(F.lit("o"), "p", "s", "o", null)).unionAll(d.select(F.lit("d"), "p", "s", "lex", "dt"))
    gone = picked(every, rate, seed)

    def left(df: DataFrame, tag: str, columns: list[str]) -> DataFrame:
        own = gone.where(F.col("t") == tag).select(*[F.col(c).alias(f"__{n}") for c, n in zip("xyzw", columns, strict=False)])
        on = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in columns]
        cond = on[0]
        for extra in on[1:]:
            cond = cond & extra
        return df.join(own, cond, "left_anti")

    return graph.replaced(class_assertion=left(a, "c", ["cls", "ind"]), obj_assertion=left(o, "o", ["p", "s", "o"]), data_assertion=left(d, "d", ["p", "s", "lex", "dt"]))


def without_individuals(graph: TripleGraph, rate: float, seed: int = 1) -> TripleGraph:
    """Without a share, in per cent, of the individuals, and without all that is said of them."""
    gone = picked(graph.universe_frame(), rate, seed).select(F.col("ind").alias("__ind"))

    def left(name: str, *columns: str) -> DataFrame:
        df = graph.table(name)
        for c in columns:
            df = df.join(gone, F.col(c) == F.col("__ind"), "left_anti")
        return df

    return graph.replaced(individuals=left("individuals", "ind"), class_assertion=left("class_assertion", "ind"), obj_assertion=left("obj_assertion", "s", "o"), data_assertion=left("data_assertion", "s"))


def with_wrong_assertions(graph: TripleGraph, rate: float, seed: int = 1) -> TripleGraph:
    """With wrong statements added: ``int(n * rate / 100)`` for ``n`` assertions of classes, links and values, if that many can be made.

    Half of them give an individual a class, drawn by hash, that it isn't asserted to have; the others turn a link round where
    that isn't asserted. Where one kind can't make its half, the other makes up for it. Every individual and link is a
    candidate and those that give nothing new are left out before any are counted, so none of the number is lost.
    """
    asserted, links = graph.table("class_assertion"), graph.table("obj_assertion")
    classes = asserted.select("cls").where("cls is not null").distinct()
    n_classes = classes.count()
    # a class's number is its rank by name
    numbered = classes.groupBy().agg(F.array_sort(F.collect_list("cls")).alias("all")).select(F.posexplode("all").alias("no", "cls"))
    drawn = graph.universe_frame().withColumn("no", F.pmod(hash_of(["ind"], seed + 1), F.lit(max(n_classes, 1))).cast("int"))
    classed = durable(drawn.join(numbered, "no").select("cls", "ind").join(asserted.select("cls", "ind"), ["cls", "ind"], "left_anti"))
    ends = links.where("s is not null and o is not null").distinct()
    turned = durable(ends.select("p", F.col("o").alias("s"), F.col("s").alias("o")).join(ends, ["p", "s", "o"], "left_anti"))
    total = int((asserted.count() + links.count() + graph.table("data_assertion").count()) * rate / 100)
    able_c, able_l = classed.count(), turned.count()
    n_c = min(able_c, total // 2)
    n_l = min(able_l, total - n_c)
    n_c = min(able_c, total - n_l)
    return graph.replaced(class_assertion=asserted.unionByName(least(classed, n_c, ["cls", "ind"], seed)), obj_assertion=links.unionByName(least(turned, n_l, ["p", "s", "o"], seed)))

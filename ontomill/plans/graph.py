"""Graph plans: connected components and transitive closure, each round planned by Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.plans.rounds import durable
from ontomill.plans.ship import arrow_rows


#: Edges of a task that are contracted together.
HELD = 500_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of ``n`` nodes' components: roots hook onto lesser roots, then paths are halved until flat."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task, replaced by a star from each node to the least node of its tree."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([c for k in (0, 1) for c in rows.column(k).chunks]).dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        label = least_labels(at[: len(rows)], at[len(rows) :], len(order))
        moved = np.flatnonzero(label != np.arange(len(order)))
        nodes = ends.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield contracted(held)
            held, rows = [], 0
    if rows:
        yield contracted(held)


def stars(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``u, v``: nodes and a lesser node that each is connected to, the least that any task knew; not yet components.

    One pass without rounds: each task contracts its own edges, and a node keeps the least of what its tasks found.
    """
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u is not null and v is not null and u <> v")
    return durable(arrow_rows(pairs, _forest, f"u {kind}, v {kind}").groupBy("u").agg(F.min("v").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; ``root`` is the least node of its component.

    Alternating large-star and small-star rounds: each round moves every edge to the least neighbour known, the number of
    edges never grows, and no node's neighbours are collected in one place (minimum by a map-side combined aggregate, then
    a join whose skewed keys adaptive execution splits). Rounds end when the edges are a set of stars. Null ends and loops
    are left out; an empty edge table gives an empty result. If the tasks' trees have ``at_once`` edges or fewer together (and no
    more than a task holds), one task contracts them to the components, without rounds.
    """
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u is not null and v is not null and u <> v")
    e = arrow_rows(pairs, _forest, f"u {kind}, v {kind}")
    # the stars of all tasks meet by node: a node has at most one edge a task, however many links it has
    e = durable(arrow_rows(e.repartition("u"), _forest, f"u {kind}, v {kind}"))
    if at_once and e.count() <= min(at_once, HELD):
        e = durable(arrow_rows(e.coalesce(1), _forest, f"u {kind}, v {kind}"))
        return _rooted(e)
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before the join, so that the join's sides are plain exchanges whose skewed keys are split
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        large = durable(large)
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u")
        e = durable(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return _rooted(e)


def _rooted(stars: DataFrame) -> DataFrame:
    """``(node, root)`` of edges that lead from each node straight to its root, the roots' own rows among them."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def transitive_closure(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``(a, b)`` for every path of one or more edges; cycles are allowed and give ``(x, x)`` rows.

    Semi-naive: only pairs that are new in a round are extended in the next. Null ends are left out.
    """
    e = durable(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").distinct())
    closure = delta = e
    step = e.select(F.col("x").alias("y"), F.col("y").alias("z"))
    for _ in range(max_rounds):
        reached = delta.join(step, "y").select("x", F.col("z").alias("y")).distinct()
        delta = durable(reached.join(closure, ["x", "y"], "left_anti"))
        if delta.isEmpty():
            break
        closure = durable(closure.unionAll(delta))
    else:
        raise RuntimeError("closure did not settle")
    return closure.select(F.col("x").alias(a), F.col("y").alias(b))


def transitive_reduction(closure: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of an acyclic closure that no path of two or more edges stands for."""
    first = closure.select(F.col(a).alias("x"), F.col(b).alias("m"))
    second = closure.select(F.col(a).alias("m"), F.col(b).alias("y"))
    longer = first.join(second, "m").select("x", "y").distinct()
    edge = closure.select(F.col(a).alias("x"), F.col(b).alias("y"))
    return edge.join(longer, ["x", "y"], "left_anti").select(F.col("x").alias(a), F.col("y").alias(b))

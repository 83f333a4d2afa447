"""Instance retrieval: a class expression compiled to one lazy DataFrame.

Every node becomes a set of individuals by kind. Where a set is some rows of a mapped table it stays a predicate, so that
conjunctions, disjunctions and complements over one table are one scan with one filter, which Catalyst pushes to the source.
Quantifiers are semi and anti joins, cardinalities are aggregates over the edges that pass the filler. Nothing is collected.
"""

from __future__ import annotations

import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.functions.literals import predicate
from ontomill.plans import algebra
from ontomill.plans import expr as E
from ontomill.plans.expr import Node
from ontomill.plans.rounds import durable
from ontomill.sources.graphs import Data, Edges, Ext, Graph

Sets = dict[str, Ext]


def with_timeout(df: DataFrame, seconds: float) -> DataFrame:
    """``df``, computed into the checkpoint folder; its jobs are cancelled and TimeoutError is raised if they take longer."""
    context, tag = df.sparkSession.sparkContext, f"ontomill-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return durable(df)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not answered within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


class Reasoner:
    """Answers class expressions over a graph under the closed world.

    ``closed=False`` leaves complements empty, as nothing says that an individual is not in a class. ``subs`` takes in
    subclasses and sub-properties. ``compat`` reads data complements and conjunctions by subject instead of by value.
    Null keys never occur in results; a name that the graph doesn't know is dropped from listings.
    """

    def __init__(self, graph: Graph, closed: bool = True, subs: bool = True, compat: bool = False):
        self.graph, self.closed, self.subs, self.compat = graph, closed, subs, compat

    def instances(self, c: Node) -> DataFrame:
        """``ind``: the distinct names of a class expression's individuals."""
        # without the closed world, a complement and its dual quantifier are not the same
        return self.named(self.sets(algebra.simplify(c) if self.closed and not self.compat else c))

    def named(self, sets: Sets) -> DataFrame:
        spark = next(iter(self.graph.universe().values())).keys().sparkSession
        frames = [s.keys().select(self.graph.name_of(k, F.col("k")).alias("ind")) for k, s in sets.items()]
        return reduce(DataFrame.unionAll, frames) if frames else spark.createDataFrame([], "ind string")

    def count(self, c: Node) -> DataFrame:
        """``n``: how many individuals a class expression has."""
        return self.instances(c).agg(F.count("*").alias("n"))

    def among(self, c: Node, examples: DataFrame) -> DataFrame:
        """Those of the names in ``examples`` (column ``ind``) that are instances."""
        return self.instances(c).join(examples.select("ind").distinct(), "ind", "left_semi")

    # ---- nodes

    def sets(self, c: Node) -> Sets:
        if c == E.THING:
            return self.graph.universe()
        if c == E.NOTHING:
            return {}
        if isinstance(c, E.Class):
            return self.graph.class_extension(c.iri, self.subs)
        if isinstance(c, E.OneOf):
            return self.listed(c.inds)
        if isinstance(c, E.Not):
            return self.minus(self.graph.universe(), self.sets(c.of)) if self.closed else {}
        if isinstance(c, E.And):
            # what leaves out few (complements, universals, upper bounds) is taken off the other conjuncts, without the universe
            lean = {x: gone for x in c.of if (gone := self.left_out(x)) is not None}
            rest = [x for x in c.of if x not in lean]
            if not rest:
                rest, lean = [c.of[0]], {x: lean[x] for x in c.of[1:]}
            start = reduce(self.both, self.cheap_first([self.sets(x) for x in rest]))
            return reduce(self.minus, lean.values(), start)
        if isinstance(c, E.Or):
            return reduce(self.either, [self.sets(x) for x in c.of])
        if isinstance(c, E.HasSelf):
            return self.gathered([(e.s_kind, e.table.where(e.s == e.o).select(e.s.alias("k"))) for e in self.graph.edges(c.prop, self.subs) if e.s_kind == e.o_kind])
        if isinstance(c, E.Some | E.All | E.Card):
            return self.on_data(c) if E.is_range(c.filler) else self.on_objects(c)
        raise TypeError(f"not a class expression: {c}")

    def left_out(self, c: Node) -> Sets | None:
        """The individuals that aren't in ``c``, if ``c`` is the universe without them; else None."""
        if isinstance(c, E.Not) and self.closed:
            return self.sets(c.of)
        if isinstance(c, E.All):
            if E.is_range(c.filler):
                return self.having(self.graph.data(c.prop.iri, self.subs), E.Not(c.filler))
            filler = {} if c.filler == E.THING else self.sets(c.filler)
            return self.gathered([(e.s_kind, self.failing(e, filler).select(e.s.alias("k"))) for e in self.graph.edges(c.prop, self.subs)] if c.filler != E.THING else [])
        if isinstance(c, E.Card) and c.op == "<=":
            return self.sets(E.Card(">=", c.n + 1, c.prop, c.filler))
        return None

    @staticmethod
    def cheap_first(sets: list[Sets]) -> list[Sets]:
        """Sets that are plain filters before those that hold joins."""
        return sorted(sets, key=lambda s: sum((x.df is not None) + (x.frame is not None) for x in s.values()))

    def listed(self, inds: tuple[str, ...]) -> Sets:
        by: dict[str, list] = {}
        for ind in inds:
            kind, key = self.graph.key_of(ind)
            by.setdefault(kind, []).append(key)
        out = {}
        for kind, ext in self.graph.universe().items():
            if kind in by and ext.df is None:
                out[kind] = Ext(ext.source, ext.source.key.isin(*by[kind]))
            elif kind in by:
                out[kind] = Ext(df=ext.df.where(F.col("k").isin(*by[kind])))
        return out

    def gathered(self, frames: list[tuple[str, DataFrame]], distinct: bool = True) -> Sets:
        by: dict[str, list[DataFrame]] = {}
        for kind, df in frames:
            by.setdefault(kind, []).append(df)
        out = {}
        for k, dfs in by.items():
            df = reduce(DataFrame.unionAll, dfs).where("k is not null")
            out[k] = Ext(df=df.distinct() if distinct or len(dfs) > 1 else df)
        return out

    @staticmethod
    def same_rows(a: Ext, b: Ext) -> bool:
        return a.source is not None and b.source is not None and a.source.name == b.source.name

    def both(self, a: Sets, b: Sets) -> Sets:
        out = {}
        for kind in a.keys() & b.keys():
            x, y = a[kind], b[kind]
            if self.same_rows(x, y) and (x.frame is None or y.frame is None):
                pred = x.pred & y.pred if x.pred is not None and y.pred is not None else x.pred if y.pred is None else y.pred
                out[kind] = Ext(x.source, pred, frame=x.frame if y.frame is None else y.frame)
            else:
                out[kind] = self.kept(x, y, "left_semi")
        return out

    @staticmethod
    def kept(x: Ext, y: Ext, how: str) -> Ext:
        """Those of ``x`` that are, or are not, in ``y``, by a join on keys; rows of a table stay rows."""
        if x.source is None:
            return Ext(df=x.keys().join(y.keys(), "k", how))
        return Ext(x.source, frame=x.rows().join(y.keys().withColumnRenamed("k", "__k"), x.source.key == F.col("__k"), how))

    def either(self, a: Sets, b: Sets) -> Sets:
        out = dict(a) | {k: v for k, v in b.items() if k not in a}
        for kind in a.keys() & b.keys():
            x, y = a[kind], b[kind]
            if self.same_rows(x, y) and x.frame is None and y.frame is None:
                out[kind] = Ext(x.source, None if x.pred is None or y.pred is None else x.pred | y.pred)
            else:
                out[kind] = Ext(df=x.keys().unionAll(y.keys()).distinct())
        return out

    def minus(self, a: Sets, b: Sets) -> Sets:
        out = {}
        for kind, x in a.items():
            y = b.get(kind)
            if y is None:
                out[kind] = x
            elif self.same_rows(x, y) and y.frame is None:
                if y.pred is not None:
                    rest = ~F.coalesce(y.pred, F.lit(False))
                    out[kind] = Ext(x.source, rest if x.pred is None else x.pred & rest, frame=x.frame)
            else:
                out[kind] = self.kept(x, y, "left_anti")
        return out

    # ---- object restrictions

    def passing(self, e: Edges, filler: Sets | None, whole: bool) -> DataFrame | None:
        """The edges whose object is in the filler (None: nothing is); ``whole`` means that every object is."""
        if whole:
            return e.table
        ext = filler.get(e.o_kind)
        if ext is None:
            return None
        if e.o_row and ext.source is not None and ext.source.name == e.rows:
            return ext.rows()
        return e.table.withColumn("__o", e.o).join(ext.keys().withColumnRenamed("k", "__k"), F.col("__o") == F.col("__k"), "left_semi")

    def failing(self, e: Edges, filler: Sets) -> DataFrame:
        """The edges whose object is not in the filler."""
        ext = filler.get(e.o_kind)
        if ext is None:
            return e.table
        if e.o_row and ext.source is not None and ext.source.name == e.rows and ext.frame is None:
            return e.table.where(F.lit(False) if ext.pred is None else ~F.coalesce(ext.pred, F.lit(False)))
        return e.table.withColumn("__o", e.o).where("__o is not null").join(ext.keys().withColumnRenamed("k", "__k"), F.col("__o") == F.col("__k"), "left_anti")

    def on_objects(self, c: E.Some | E.All | E.Card) -> Sets:
        edges = self.graph.edges(c.prop, self.subs)
        whole = c.filler == E.THING
        filler = {} if whole else self.sets(c.filler)
        if isinstance(c, E.All):
            bad = [] if whole else [(e.s_kind, self.failing(e, filler).select(e.s.alias("k"))) for e in edges]
            return self.minus(self.graph.universe(), self.gathered(bad))
        if isinstance(c, E.Some):
            found = [(e, self.passing(e, filler, whole)) for e in edges]
            out: Sets = {}
            for e, df in found:
                if df is None:
                    continue
                linked = df.where(e.o.isNotNull())
                own = self.graph.universe().get(e.s_kind) if e.s_row else None
                if own is not None and own.source is not None and own.source.name == e.rows:  # each row is another subject
                    out = self.either(out, {e.s_kind: Ext(own.source, frame=linked)})
                else:
                    out = self.either(out, self.gathered([(e.s_kind, linked.select(e.s.alias("k")))]))
            return out
        return self.counted(c, edges, filler, whole)

    def counted(self, c: E.Card, edges: list[Edges], filler: Sets, whole: bool) -> Sets:
        universe = self.graph.universe()
        if c.op == ">=" and c.n <= 0:
            return universe
        by: dict[str, list[Edges]] = {}
        for e in edges:
            by.setdefault(e.s_kind, []).append(e)

        def subjects(keep: Column, least: int) -> Sets:
            out = {}
            for kind, same in by.items():
                frames = [(e, df) for e in same if (df := self.passing(e, filler, whole)) is not None]
                if not frames:
                    continue
                if len(frames) == 1 and frames[0][0].unique:
                    e, df = frames[0]
                    n = df.where(e.o.isNotNull() & e.s.isNotNull()).groupBy(e.s.alias("k")).agg(F.count("*").alias("n"))
                else:  # an object may be reached over several edges: it counts once
                    pairs = reduce(DataFrame.unionAll, [df.select(e.s.alias("k"), F.lit(e.o_kind).alias("kind"), e.o.cast("string").alias("o")) for e, df in frames])
                    n = pairs.where("k is not null and o is not null").distinct().groupBy("k").agg(F.count("*").alias("n"))
                out[kind] = Ext(df=n.where(keep).select("k"))
            return out

        if c.op == ">=":
            return subjects(F.col("n") >= c.n, c.n)
        if c.op == "=" and c.n > 0:
            return subjects(F.col("n") == c.n, c.n)
        return self.minus(universe, subjects(F.col("n") > c.n, c.n + 1))

    # ---- data restrictions

    def on_data(self, c: E.Some | E.All | E.Card) -> Sets:
        data = self.graph.data(c.prop.iri, self.subs)
        if self.compat and isinstance(c, E.Some) and isinstance(c.filler, E.Not | E.And | E.Or):
            return self.by_subject(c)
        if isinstance(c, E.All):
            return self.minus(self.graph.universe(), self.having(data, E.Not(c.filler)))
        if isinstance(c, E.Some) or (c.op, c.n) == (">=", 1):
            return self.having(data, c.filler)
        if c.op == ">=" and c.n <= 0:
            return self.graph.universe()
        if c.op == "<=":
            return self.minus(self.graph.universe(), self.on_data(E.Card(">=", c.n + 1, c.prop, c.filler)))
        if c.op == "=":
            more = self.on_data(E.Card(">=", c.n + 1, c.prop, c.filler))
            return self.minus(self.on_data(E.Card(">=", c.n, c.prop, c.filler)), more)
        out: Sets = {}
        for kind, same in self.by_kind(data).items():
            frames = [self.values(d).where(predicate(c.filler, self.plain(d))).select("k", "dt", "lex") for d in same if d.source is None or len(same) > 1]
            if frames:  # a column has one value a row: alone it never counts more than one
                n = reduce(DataFrame.unionAll, frames).distinct().groupBy("k").agg(F.count("*").alias("n"))
                out[kind] = Ext(df=n.where(F.col("n") >= c.n).select("k"))
        return out

    @staticmethod
    def by_kind(data: list[Data]) -> dict[str, list[Data]]:
        out: dict[str, list[Data]] = {}
        for d in data:
            out.setdefault(d.kind, []).append(d)
        return out

    @staticmethod
    def values(d: Data) -> DataFrame:
        dt = F.lit(d.value.datatype) if isinstance(d.value.datatype, str) else d.value.datatype
        df = d.df if d.source is None else d.source.df.where(d.value.native.isNotNull())
        key = F.col("s") if d.source is None else d.source.key
        native = d.value.native if d.value.native is not None else F.lit(None)
        return df.select(key.alias("k"), d.value.lex.alias("lex"), dt.alias("dt"), native.alias("native"))

    @staticmethod
    def plain(d: Data):  # noqa: ANN205
        from ontomill.functions.literals import Value

        return Value(F.col("lex"), d.value.datatype if isinstance(d.value.datatype, str) else F.col("dt"), None if d.value.native is None else F.col("native"))

    def having(self, data: list[Data], r: Node) -> Sets:
        """Subjects with a value in the range."""
        out: Sets = {}
        for d in data:
            if d.source is not None:
                out = self.either(out, {d.kind: Ext(d.source, d.value.native.isNotNull() & predicate(r, d.value))})
            else:
                out = self.either(out, self.gathered([(d.kind, d.df.where(predicate(r, d.value)).select(F.col("s").alias("k")))]))
        return out

    def by_subject(self, c: E.Some) -> Sets:
        if isinstance(c.filler, E.Not):
            return self.minus(self.on_data(E.Some(c.prop, E.ANY_LITERAL)), self.on_data(E.Some(c.prop, c.filler.of)))
        parts = [self.on_data(E.Some(c.prop, x)) for x in c.filler.of]
        return reduce(self.both if isinstance(c.filler, E.And) else self.either, parts)

    # ---- navigation from individuals

    def object_property_values(self, ind: str, prop: E.Prop) -> DataFrame:
        """``o``: names that an individual is linked to."""
        kind, key = self.graph.key_of(ind)
        frames = [e.table.where(e.s == F.lit(key)).select(self.graph.name_of(e.o_kind, e.o).alias("o")) for e in self.graph.edges(prop, self.subs) if e.s_kind == kind]
        return reduce(DataFrame.unionAll, frames).where("o is not null").distinct() if frames else self.named({}).withColumnRenamed("ind", "o")

    def data_property_values(self, prop: str, ind: str | None = None) -> DataFrame:
        """``s, lex, dt`` of a data property, of one individual if given (a bag)."""
        frames = []
        for d in self.graph.data(prop, self.subs):
            df = self.values(d)
            if ind is not None:
                kind, key = self.graph.key_of(ind)
                df = df.where(F.col("k") == F.lit(key)) if kind == d.kind else df.limit(0)
            frames.append(df.select(self.graph.name_of(d.kind, F.col("k")).alias("s"), "lex", "dt"))
        return reduce(DataFrame.unionAll, frames)

    def types(self, ind: str, classes: list[str]) -> DataFrame:
        """``cls``: which of the classes an individual is in."""
        kind, key = self.graph.key_of(ind)
        frames = []
        for c in classes:
            s = self.graph.class_extension(c, self.subs).get(kind)
            if s is not None:
                frames.append(s.keys().where(F.col("k") == F.lit(key)).select(F.lit(c).alias("cls")))
        return reduce(DataFrame.unionAll, frames) if frames else self.named({}).withColumnRenamed("ind", "cls")

"""Knowledge graphs as DataFrames: triples in tables, and relational tables mapped in place.

A graph is many-sorted: individuals are grouped by kind, and a kind's individuals have a key of one type. A mapped graph has a
kind for each table's rows, so joins run on the tables' own keys and names are made for results only. A triple graph has one
kind, whose keys are IRIs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.functions.literals import Value
from ontomill.plans import expr as E
from ontomill.plans.expr import Prop
from ontomill.plans.graph import transitive_closure
from ontomill.plans.rounds import durable, stored


#: A table, or what reads it when a query first touches it.
Table = DataFrame | Callable[[], DataFrame]


def _read(table: Table) -> DataFrame:
    return table if isinstance(table, DataFrame) else table()


@dataclass(frozen=True)
class Source:
    """A table whose rows are individuals: its key is unique."""

    name: str
    table: Table
    key: Column

    @property
    def df(self) -> DataFrame:
        return _read(self.table)


@dataclass(frozen=True)
class Ext:
    """Individuals of one kind: rows of a source, or a DataFrame of distinct keys ``k``.

    The rows are those of ``frame`` (by default the source's table) that ``pred`` picks; a frame is the table after joins that
    only leave rows out, so it has the table's columns and further restrictions on the same rows need no join by key.
    """

    source: Source | None = None
    pred: Column | None = None
    df: DataFrame | None = None
    frame: DataFrame | None = None

    def rows(self) -> DataFrame:
        table = self.source.df if self.frame is None else self.frame
        return table if self.pred is None else table.where(self.pred)

    def keys(self) -> DataFrame:
        return self.df if self.df is not None else self.rows().select(self.source.key.alias("k"))


@dataclass(frozen=True)
class Edges:
    """Pairs ``s``, ``o`` of a property between two kinds.

    ``rows`` names the table whose row each pair is, and whether the row is the subject's or the object's own; ``unique`` says
    that no pair occurs twice.
    """

    s_kind: str
    o_kind: str
    pairs: Table
    s: Column
    o: Column
    rows: str | None = None
    s_row: bool = False
    o_row: bool = False
    unique: bool = False

    @property
    def table(self) -> DataFrame:
        return _read(self.pairs)

    def flipped(self) -> Edges:
        return Edges(self.o_kind, self.s_kind, self.pairs, self.o, self.s, self.rows, self.o_row, self.s_row, self.unique)


@dataclass(frozen=True)
class Data:
    """Values of a data property: rows of a kind's source with one value each, or a table with a subject column ``s``."""

    kind: str
    value: Value
    source: Source | None = None
    df: DataFrame | None = None


class Graph:
    """What retrieval needs of a graph."""

    def universe(self) -> dict[str, Ext]:
        raise NotImplementedError

    def class_extension(self, iri: str, subs: bool = True) -> dict[str, Ext]:
        raise NotImplementedError

    def edges(self, prop: Prop, subs: bool = True) -> list[Edges]:
        raise NotImplementedError

    def data(self, iri: str, subs: bool = True) -> list[Data]:
        raise NotImplementedError

    def key_of(self, ind: str) -> tuple[str, object]:
        """Kind and key of a name."""
        raise NotImplementedError

    def name_of(self, kind: str, key: Column) -> Column:
        raise NotImplementedError


@dataclass
class MappedGraph(Graph):
    """Relational tables as a graph, without copying: a class is a table or some of its rows, a property some of its columns."""

    sources: dict[str, Source] = field(default_factory=dict)
    key_types: dict[str, str] = field(default_factory=dict)
    classes: dict[str, tuple[str, Column | None]] = field(default_factory=dict)
    supers: dict[str, str] = field(default_factory=dict)
    objects: dict[str, Edges] = field(default_factory=dict)
    inverses: dict[str, str] = field(default_factory=dict)
    sub_properties: dict[str, tuple[str, ...]] = field(default_factory=dict)
    values: dict[str, list[Data]] = field(default_factory=dict)

    def add_kind(self, kind: str, iri: str, table: str, df: Table, key: Column, key_type: str = "bigint") -> None:
        """A class of all rows of a table; ``key`` is unique."""
        self.sources[kind], self.key_types[kind] = Source(table, df, key), key_type
        self.classes[iri] = (kind, None)

    def add_class(self, iri: str, parent: str, pred: Column) -> None:
        """A subclass: the rows of its parent's table that ``pred`` picks."""
        kind, own = self.classes[parent]
        self.classes[iri] = (kind, pred if own is None else own & pred)
        self.supers[iri] = parent

    def add_object(self, iri: str, table: str, df: Table, s: tuple[str, Column], o: tuple[str, Column], row: str = "", inverse: str | None = None) -> None:
        """A property between kinds; ``row`` is ``s`` or ``o`` if each row of the table is that end's own."""
        self.objects[iri] = Edges(s[0], o[0], df, s[1], o[1], table, row == "s", row == "o", bool(row))
        if inverse:
            self.inverses[inverse] = iri

    def add_data(self, iri: str, kind: str, column: Column, datatype: str) -> None:
        lex = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss") if datatype == E.XSD + "dateTime" else column.cast("string")
        self.values.setdefault(iri, []).append(Data(kind, Value(lex, datatype, column), self.sources[kind]))

    def universe(self) -> dict[str, Ext]:
        return {k: Ext(s) for k, s in self.sources.items()}

    def class_extension(self, iri: str, subs: bool = True) -> dict[str, Ext]:
        if iri not in self.classes:
            return {}
        kind, pred = self.classes[iri]
        return {kind: Ext(self.sources[kind], pred)}

    def _with_subs(self, iri: str, subs: bool) -> list[str]:
        out = [iri]
        for x in out:
            out += [y for y in self.sub_properties.get(x, ()) if y not in out] if subs else []
        return out

    def edges(self, prop: Prop, subs: bool = True) -> list[Edges]:
        out = []
        for iri in self._with_subs(prop.iri, subs):
            base, inverse = (iri, prop.inverse) if iri in self.objects else (self.inverses.get(iri), not prop.inverse)
            if base in self.objects:
                out.append(self.objects[base].flipped() if inverse else self.objects[base])
        return out

    def data(self, iri: str, subs: bool = True) -> list[Data]:
        return [d for x in self._with_subs(iri, subs) for d in self.values.get(x, ())]

    def key_of(self, ind: str) -> tuple[str, object]:
        kind, _, key = ind.partition("/")
        return kind, int(key) if self.key_types.get(kind) == "bigint" and key.lstrip("-").isdigit() else key

    def name_of(self, kind: str, key: Column) -> Column:
        return F.concat(F.lit(kind + "/"), key.cast("string"))


TABLES = {
    "individuals": "ind string",
    "class_assertion": "cls string, ind string",
    "obj_assertion": "p string, s string, o string",
    "data_assertion": "p string, s string, lex string, dt string",
    "sub_class": "sub string, sup string",
    "sub_prop": "sub string, sup string",
    "inverse_prop": "p string, q string",
    "domain": "p string, cls string",
    "range": "p string, cls string",
    "characteristic": "p string, name string",
    "disjoint_class": "a string, b string",
    "equivalent_class": "a string, b string",
    "equivalent_prop": "a string, b string",
    "disjoint_prop": "a string, b string",
    "same_as": "a string, b string",
    "different_from": "a string, b string",
    "prop_chain": "p string, chain array<string>",
    "annotation": "s string, p string, value string",
    "iri_annotation": "s string, p string, value string",
    "language": "p string, s string, lex string, lang string",
    "entity": "iri string, kind string",
    "complex_axiom": "kind string, args array<string>",
    "neg_obj_assertion": "p string, s string, o string",
    "neg_data_assertion": "p string, s string, lex string, dt string",
}
#: The tables that speak of individuals; the others hold the schema, declarations and annotations.
ASSERTIONS = ("individuals", "class_assertion", "obj_assertion", "data_assertion", "language", "same_as", "different_from", "neg_obj_assertion", "neg_data_assertion")


#: Schema edges, and pairs of their closure, up to which a closure is made on the driver; beyond, by rounds of joins.
SMALL, SMALL_CLOSURE = 20_000, 500_000


def small_closure(edges: DataFrame) -> set[tuple[str, str]] | None:
    """All pairs of names joined by a path, if the schema is small; else None."""
    rows = edges.limit(SMALL + 1).collect()
    return None if len(rows) > SMALL else closed_pairs(rows)


def closed_pairs(rows: Iterable[tuple[str, str]]) -> set[tuple[str, str]] | None:
    """All pairs of names joined by a path of the given edges; None if there are over ``SMALL_CLOSURE``."""
    up: dict[str, set[str]] = {}
    for a, b in rows:
        up.setdefault(a, set()).add(b)
    out: set[tuple[str, str]] = set()
    for start in up:
        seen: set[str] = set()
        queue = list(up[start])
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                queue.extend(up.get(x, ()))
        out.update((start, x) for x in seen)
        if len(out) > SMALL_CLOSURE:
            return None
    return out


class TripleGraph(Graph):
    """Assertions and axioms in tables of fixed schemas (``TABLES``); a missing table is empty."""

    KIND = ""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.version = 0
        #: Whether ``individuals`` holds every individual of the other tables, once, as after materialisation.
        self.complete = False
        given = tables or {}
        self.tables = {name: given[name] if name in given else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        self._closures: dict[tuple[str, int], DataFrame] = {}
        self._pairs_of: dict[tuple[str, int], set[tuple[str, str]] | None] = {}

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def replaced(self, **tables: DataFrame) -> TripleGraph:
        """A graph with some tables replaced; closures that were computed are not taken over."""
        return TripleGraph(self.spark, self.tables | tables)

    def universe_frame(self) -> DataFrame:
        """All named individuals: declared ones and those in assertions; computed once, as every complement starts from it."""
        key = ("universe", self.version)
        if key in self._closures:
            return self._closures[key]
        t = self.tables
        if self.complete:
            self._closures[key] = stored(t["individuals"].select("ind").where("ind is not null"))
            return self._closures[key]
        found = t["individuals"].select("ind").unionAll(t["class_assertion"].select("ind")).unionAll(t["obj_assertion"].select("s")).unionAll(t["obj_assertion"].select("o")).unionAll(t["data_assertion"].select("s"))
        self._closures[key] = durable(found.where("ind is not null").distinct())
        return self._closures[key]

    def universe(self) -> dict[str, Ext]:
        return {self.KIND: Ext(df=self.universe_frame().withColumnRenamed("ind", "k"))}

    def schema_edges(self, name: str) -> DataFrame:
        """``sub, sup`` of asserted and equivalent edges; name is sub_class or sub_prop."""
        same = self.tables["equivalent_class" if name == "sub_class" else "equivalent_prop"]
        return self.tables[name].unionAll(same.select("a", "b")).unionAll(same.select("b", "a")).where("sub is not null and sup is not null")

    def closure(self, name: str) -> DataFrame:
        """``sub, sup`` of every path of asserted, equivalent and inherited edges."""
        key = (name, self.version)
        if key not in self._closures:
            pairs = small_closure(self.schema_edges(name))
            self._pairs_of[key] = pairs
            self._closures[key] = self.spark.createDataFrame(sorted(pairs), "sub string, sup string") if pairs is not None else transitive_closure(self.schema_edges(name), "sub", "sup")
        return self._closures[key]

    def below(self, name: str, iri: str) -> DataFrame:
        """``sub``: the name and all that are below it."""
        own = self.spark.range(1).select(F.lit(iri).alias("sub"))
        return self.closure(name).where(F.col("sup") == iri).select("sub").unionAll(own).distinct()

    def names_below(self, name: str, iri: str, subs: bool = True) -> list[str] | None:
        """The same as a list if the schema is small, else None."""
        if not subs:
            return [iri]
        self.closure(name)
        pairs = self._pairs_of[(name, self.version)]
        return None if pairs is None else sorted({iri, *(a for a, b in pairs if b == iri)})

    def _named(self, table: DataFrame, column: str, name: str, iri: str, subs: bool) -> DataFrame:
        """Rows whose column is the name or below it: a filter on constants, which prunes what is stored apart by name, or a semi join."""
        names = self.names_below(name, iri, subs)
        return table.where(F.col(column).isin(*names)) if names is not None else table.join(self.below(name, iri), F.col(column) == F.col("sub"), "left_semi")

    def class_extension(self, iri: str, subs: bool = True) -> dict[str, Ext]:
        rows = self._named(self.tables["class_assertion"], "cls", "sub_class", iri, subs)
        return {self.KIND: Ext(df=rows.select(F.col("ind").alias("k")).where("k is not null").distinct())}

    def _inverses(self) -> list[tuple[str, str]] | None:
        """Declared inverses both ways, as a list if there are few."""
        key = ("inverse", self.version)
        if key not in self._pairs_of:
            rows = self.tables["inverse_prop"].limit(SMALL + 1).collect()
            self._pairs_of[key] = None if len(rows) > SMALL else {(a, b) for r in rows for a, b in ((r.p, r.q), (r.q, r.p))}
        return self._pairs_of[key]

    def _pairs(self, iri: str, subs: bool) -> DataFrame:
        """``s, o`` of a property, of those below it, and of declared inverses read backwards."""
        t = self.tables["obj_assertion"]
        names, inverses = self.names_below("sub_prop", iri, subs), self._inverses()
        straight = self._named(t, "p", "sub_prop", iri, subs).select("s", "o")
        if names is not None and inverses is not None:
            back = sorted({q for p, q in inverses if p in names})
            if not back:
                return straight.where("s is not null and o is not null")
            backward = t.where(F.col("p").isin(*back))
        else:
            inv = self.tables["inverse_prop"]
            both = inv.select("p", "q").unionAll(inv.select("q", "p")).distinct()
            back = both.join(self.below("sub_prop", iri), F.col("p") == F.col("sub"), "left_semi").select(F.col("q").alias("sub")).distinct()
            backward = t.join(back, t["p"] == F.col("sub"), "left_semi")
        return straight.unionAll(backward.select(F.col("o").alias("s"), F.col("s").alias("o"))).where("s is not null and o is not null")

    def edges(self, prop: Prop, subs: bool = True) -> list[Edges]:
        e = Edges(self.KIND, self.KIND, self._pairs(prop.iri, subs), F.col("s"), F.col("o"))
        return [e.flipped() if prop.inverse else e]

    def data(self, iri: str, subs: bool = True) -> list[Data]:
        rows = self._named(self.tables["data_assertion"], "p", "sub_prop", iri, subs)
        return [Data(self.KIND, Value(F.col("lex"), F.col("dt")), df=rows.select("s", "lex", "dt").where("s is not null"))]

    def key_of(self, ind: str) -> tuple[str, object]:
        return self.KIND, ind

    def name_of(self, kind: str, key: Column) -> Column:
        return key

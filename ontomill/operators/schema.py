"""Navigation of class and property hierarchies, and what is declared of them.

All of it works on closures that are DataFrames; ``direct`` leaves out what follows over another name in between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.graph import connected_components, transitive_closure
from ontomill.sources.graphs import TripleGraph


class Hierarchy:
    """A hierarchy of names from edges ``sub, sup``; cycles stand for equivalence, and top and bottom are not stored."""

    def __init__(self, edges: DataFrame, items: DataFrame | None = None):
        pairs = edges.select("sub", "sup").where("sub is not null and sup is not null")
        self.closure = transitive_closure(pairs, "sub", "sup")
        known = pairs.select(F.col("sub").alias("item")).unionAll(pairs.select("sup"))
        self.items = (known.unionAll(items.select("item")) if items is not None else known).distinct()
        back = self.closure.select(F.col("sup").alias("x"), F.col("sub").alias("y"))
        #: pairs of different names that lie strictly above one another
        self.strict = self.closure.where("sub <> sup").join(back, (F.col("sub") == F.col("x")) & (F.col("sup") == F.col("y")), "left_anti")

    def covers(self) -> DataFrame:
        """``sub, sup`` without any strict pair that goes over a third name."""
        first = self.strict.select(F.col("sub").alias("x"), F.col("sup").alias("m"))
        second = self.strict.select(F.col("sub").alias("m"), F.col("sup").alias("y"))
        over = first.join(second, "m").select(F.col("x").alias("sub"), F.col("y").alias("sup")).distinct()
        return self.strict.join(over, ["sub", "sup"], "left_anti")

    def _edges(self, direct: bool) -> DataFrame:
        return self.covers() if direct else self.closure.where("sub <> sup")

    def parents(self, name: str, direct: bool = True) -> DataFrame:
        return self._edges(direct).where(F.col("sub") == name).select(F.col("sup").alias("item"))

    def children(self, name: str, direct: bool = True) -> DataFrame:
        if name == E.THING.iri:
            return self.roots() if direct else self.items
        return self._edges(direct).where(F.col("sup") == name).select(F.col("sub").alias("item"))

    def siblings(self, name: str) -> DataFrame:
        """Other children of the name's parents."""
        edges = self.covers()
        up = edges.where(F.col("sub") == name).select(F.col("sup").alias("up"))
        return edges.join(up, F.col("sup") == F.col("up"), "left_semi").where(F.col("sub") != name).select(F.col("sub").alias("item")).distinct()

    def roots(self) -> DataFrame:
        return self.items.join(self.strict.select(F.col("sub").alias("item")), "item", "left_anti")

    def leaves(self) -> DataFrame:
        return self.items.join(self.strict.select(F.col("sup").alias("item")), "item", "left_anti")

    def is_parent_of(self, a: str, b: str) -> bool:
        return a == b or a == E.THING.iri or not self.closure.where((F.col("sub") == b) & (F.col("sup") == a)).isEmpty()

    def is_child_of(self, a: str, b: str) -> bool:
        return self.is_parent_of(b, a)

    def restricted(self, keep: DataFrame) -> Hierarchy:
        """The hierarchy among some of the items (column ``item``), paths over others kept."""
        k = keep.select("item").distinct()
        edges = self.closure.join(k.withColumnRenamed("item", "sub"), "sub", "left_semi").join(k.withColumnRenamed("item", "sup"), "sup", "left_semi")
        return Hierarchy(edges.where("sub <> sup").select("sub", "sup"), k)

    def classes(self) -> DataFrame:
        """``node, root``: names that lie above each other, by the least name."""
        return connected_components(self.closure.join(self.closure.select(F.col("sup").alias("sub"), F.col("sub").alias("sup")), ["sub", "sup"], "left_semi"), "sub", "sup")


class Schema:
    """Services on a triple graph's axioms."""

    def __init__(self, graph: TripleGraph):
        self.graph = graph

    def classes(self) -> DataFrame:
        """``iri``: declared classes and those that occur in assertions and axioms of any kind."""
        t = self.graph.tables
        found = [t["entity"].where("kind = 'Class'").select("iri"), t["class_assertion"].select("cls"), t["sub_class"].select("sub"), t["sub_class"].select("sup"), t["domain"].select("cls")]
        found += [t[n].select(c) for n in ("equivalent_class", "disjoint_class") for c in ("a", "b")]
        found.append(t["range"].join(self._data_properties().withColumnRenamed("iri", "p"), "p", "left_anti").select("cls"))
        return reduce(DataFrame.unionAll, found).where("iri is not null").distinct()

    def _data_properties(self) -> DataFrame:
        """``iri``: properties with values or declared for them, and what stands below, above or beside one in an axiom."""
        t = self.graph.tables
        own = t["entity"].where("kind = 'DatatypeProperty'").select("iri").unionAll(t["data_assertion"].select("p")).unionAll(t["neg_data_assertion"].select("p")).where("iri is not null").distinct()
        return self._with_kin(own)

    def _with_kin(self, own: DataFrame) -> DataFrame:
        """Names and those that hierarchy, equivalence and disjointness axioms of properties connect to them: a kind is shared."""
        t = self.graph.tables
        edges = t["sub_prop"].select(F.col("sub").alias("a"), F.col("sup").alias("b")).unionAll(t["equivalent_prop"]).unionAll(t["disjoint_prop"])
        parts = connected_components(edges, "a", "b")
        roots = parts.join(own, F.col("node") == F.col("iri"), "left_semi").select(F.col("root").alias("r")).distinct()
        return own.unionAll(parts.join(roots, F.col("root") == F.col("r"), "left_semi").select("node")).distinct()

    def properties(self, kind: str | None = None) -> DataFrame:
        """``iri``: object properties, data properties, or both, whether declared, asserted or only spoken of in axioms.

        A property of which nothing says that it is a data property is an object property.
        """
        data = self._data_properties()
        if kind == "data":
            return data
        t = self.graph.tables
        found = [t["entity"].where("kind = 'ObjectProperty'").select("iri"), t["obj_assertion"].select("p"), t["neg_obj_assertion"].select("p"), t["sub_prop"].select("sub"), t["sub_prop"].select("sup"), t["inverse_prop"].select("p"), t["inverse_prop"].select("q")]
        found += [t["domain"].select("p"), t["range"].select("p"), t["characteristic"].select("p"), t["prop_chain"].select("p"), t["prop_chain"].select(F.explode("chain"))]
        found += [t[n].select(c) for n in ("equivalent_prop", "disjoint_prop") for c in ("a", "b")]
        every = reduce(DataFrame.unionAll, found).where("iri is not null").distinct()
        return every.join(data, "iri", "left_anti") if kind == "object" else every.unionAll(data).distinct()

    def signature(self) -> DataFrame:
        return self.classes().unionAll(self.properties()).unionAll(self.graph.universe_frame().withColumnRenamed("ind", "iri")).distinct()

    def class_hierarchy(self) -> Hierarchy:
        same = self.graph.table("equivalent_class")
        return Hierarchy(self.graph.table("sub_class").unionAll(same.select("a", "b")).unionAll(same.select("b", "a")), self.classes().withColumnRenamed("iri", "item"))

    def property_hierarchy(self, kind: str | None = None) -> Hierarchy:
        """The hierarchy of object properties, of data properties, or of both in one."""
        same = self.graph.table("equivalent_prop")
        edges = self.graph.table("sub_prop").unionAll(same.select("a", "b")).unionAll(same.select("b", "a"))
        items = self.properties(kind).withColumnRenamed("iri", "item")
        if kind is not None:
            edges = edges.join(items, F.col("sub") == F.col("item"), "left_semi")
        return Hierarchy(edges, items)

    def _equal(self, table: str, name: str) -> DataFrame:
        """``iri``: names connected to ``name`` by declared equivalence, without it."""
        parts = connected_components(self.graph.table(table), "a", "b")
        root = parts.where(F.col("node") == name).select(F.col("root").alias("r"))
        return parts.join(root, F.col("root") == F.col("r"), "left_semi").where(F.col("node") != name).select(F.col("node").alias("iri"))

    def equivalent_classes(self, name: str) -> DataFrame:
        return self._equal("equivalent_class", name)

    def equivalent_properties(self, name: str) -> DataFrame:
        return self._equal("equivalent_prop", name)

    def same_individuals(self, name: str) -> DataFrame:
        return self._equal("same_as", name)

    def different_individuals(self, name: str) -> DataFrame:
        t = self.graph.table("different_from")
        return t.where(F.col("a") == name).select(F.col("b").alias("iri")).unionAll(t.where(F.col("b") == name).select("a")).distinct()

    def _disjoint(self, table: str, closure: str, name: str) -> DataFrame:
        """Names disjoint with the name or one above it, and all below or equal to them; bottom is disjoint with everything."""
        t, c = self.graph.table(table), self.graph.closure(closure)
        both = t.select("a", "b").unionAll(t.select("b", "a"))
        own = self.graph.spark.range(1).select(F.lit(name).alias("up"))
        up = c.where(F.col("sub") == name).select(F.col("sup").alias("up")).unionAll(own).distinct()
        hit = both.join(up, F.col("a") == F.col("up"), "left_semi").select(F.col("b").alias("iri")).distinct()
        below = c.join(hit, F.col("sup") == F.col("iri"), "left_semi").select(F.col("sub").alias("iri"))
        return hit.unionAll(below).where(F.col("iri") != E.NOTHING.iri).distinct()

    def disjoint_classes(self, name: str) -> DataFrame:
        return self._disjoint("disjoint_class", "sub_class", name)

    def disjoint_properties(self, name: str) -> DataFrame:
        return self._disjoint("disjoint_prop", "sub_prop", name)

    def super_classes(self, name: str, direct: bool = False) -> DataFrame:
        return self.class_hierarchy().parents(name, direct)

    def sub_classes(self, name: str, direct: bool = False) -> DataFrame:
        return self.class_hierarchy().children(name, direct)

    def super_properties(self, name: str, direct: bool = False) -> DataFrame:
        return self.property_hierarchy().parents(name, direct)

    def sub_properties(self, name: str, direct: bool = False) -> DataFrame:
        return self.property_hierarchy().children(name, direct)

    def _stated(self, table: str, name: str, direct: bool) -> DataFrame:
        """Domains or ranges of a property and of those above it; of none, top.

        ``direct`` keeps those that aren't above another one; without it all classes above them come too.
        """
        above = self.graph.closure("sub_prop").where(F.col("sub") == name).select(F.col("sup").alias("q"))
        above = above.unionAll(self.graph.spark.range(1).select(F.lit(name).alias("q"))).distinct()
        stated = self.graph.table(table).join(above, F.col("p") == F.col("q"), "left_semi").select(F.col("cls").alias("iri")).distinct()
        higher = self.graph.closure("sub_class").where("sub <> sup").join(stated, F.col("sub") == F.col("iri"), "left_semi").select(F.col("sup").alias("iri")).distinct()
        out = stated.join(higher, "iri", "left_anti") if direct else stated.unionAll(higher).distinct()
        top = self.graph.spark.range(1).select(F.lit(E.THING.iri).alias("iri"))
        some = out.select(F.lit(1).alias("one")).limit(1)
        return out.unionAll(top.join(some, F.lit(True), "left_anti"))

    def domains(self, name: str, direct: bool = True) -> DataFrame:
        return self._stated("domain", name, direct)

    def ranges(self, name: str, direct: bool = True) -> DataFrame:
        return self._stated("range", name, direct)

    def types(self, ind: str, direct: bool = False) -> DataFrame:
        """``iri``: classes of an individual; ``direct`` leaves out those above another of them."""
        own = self.graph.table("class_assertion").where(F.col("ind") == ind).select(F.col("cls").alias("iri")).distinct()
        up = self.graph.closure("sub_class").where("sub <> sup").join(own, F.col("sub") == F.col("iri"), "left_semi").select(F.col("sup").alias("iri")).distinct()
        return own.join(up, "iri", "left_anti") if direct else own.unionAll(up).distinct()

    def properties_of(self, ind: str, kind: str = "object") -> DataFrame:
        """``p``: properties with a value for an individual."""
        return self.graph.table("obj_assertion" if kind == "object" else "data_assertion").where(F.col("s") == ind).select("p").distinct()

    def boxes(self) -> dict[str, int]:
        """Statements by box: assertions, class axioms, property axioms."""
        t = self.graph.tables
        by = {"A": ("class_assertion", "obj_assertion", "data_assertion", "same_as", "different_from", "neg_obj_assertion", "neg_data_assertion"), "T": ("sub_class", "equivalent_class", "disjoint_class", "domain", "range", "entity"), "R": ("sub_prop", "inverse_prop", "characteristic", "equivalent_prop", "disjoint_prop", "prop_chain")}
        return {box: sum(t[n].count() for n in names) for box, names in by.items()}

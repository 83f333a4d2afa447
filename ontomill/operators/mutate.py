"""Statements added to and removed from a triple graph: each kind of axiom is rows of one of its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.expr import Axiom, Class, Literal, Prop
from ontomill.plans.syntax import render_dl
from ontomill.sources.graphs import TABLES, TripleGraph

#: Table of each kind whose arguments are a row as they stand.
ROWS = {
    "SubObjectPropertyOf": "sub_prop", "SubDataPropertyOf": "sub_prop", "InverseObjectProperties": "inverse_prop",
    "ObjectPropertyDomain": "domain", "DataPropertyDomain": "domain", "ObjectPropertyRange": "range", "DataPropertyRange": "range", "AnnotationPropertyDomain": "domain", "AnnotationPropertyRange": "range", "SubAnnotationPropertyOf": "sub_prop",
}
PAIRWISE = {"EquivalentClasses": "equivalent_class", "DisjointClasses": "disjoint_class", "EquivalentObjectProperties": "equivalent_prop", "EquivalentDataProperties": "equivalent_prop", "DisjointObjectProperties": "disjoint_prop", "DisjointDataProperties": "disjoint_prop", "SameIndividual": "same_as", "DifferentIndividuals": "different_from"}


def _iri(x) -> str:  # noqa: ANN001
    return x.iri if isinstance(x, Class | Prop | E.Datatype) else x


def _named(x) -> bool:  # noqa: ANN001
    return isinstance(x, str | Class | E.Datatype) or isinstance(x, Prop) and not x.inverse


def rows_of(a: Axiom) -> list[tuple[str, tuple]]:
    """``(table, row)`` pairs that stand for an axiom; one over complex expressions is a row of ``complex_axiom``."""
    k, x = a.kind, a.args
    if k == "Declaration":
        return [("entity", (_iri(x[1]), x[0]))] + ([("individuals", (_iri(x[1]),))] if x[0] == "NamedIndividual" else [])
    if k in ("ObjectPropertyAssertion", "NegativeObjectPropertyAssertion"):
        p, s, o = x
        s, o = (o, s) if isinstance(p, Prop) and p.inverse else (s, o)
        return [("obj_assertion" if k[0] == "O" else "neg_obj_assertion", (_iri(p), s, o))]
    if k in ("DataPropertyAssertion", "NegativeDataPropertyAssertion"):
        value: Literal = x[2]
        spoken = [("language", (_iri(x[0]), x[1], value.lex, value.lang))] if value.lang else []
        return [("data_assertion" if k[0] == "D" else "neg_data_assertion", (_iri(x[0]), x[1], value.lex, value.datatype)), *spoken]
    if k == "AnnotationAssertion":
        # a note is (subject, property, value)
        value = x[2]
        if not isinstance(value, Literal):
            return [("iri_annotation", (_iri(x[0]), _iri(x[1]), _iri(value)))]
        return [("annotation", (_iri(x[0]), _iri(x[1]), value.lex))] + ([("language", (_iri(x[1]), _iri(x[0]), value.lex, value.lang))] if value.lang else [])
    if k == "SubPropertyChainOf":
        return [("prop_chain", (_iri(x[1]), [("^" if isinstance(p, Prop) and p.inverse else "") + _iri(p) for p in x[0]]))]
    if k.endswith("ObjectProperty") and E.KINDS[k][1] == 1:
        return [("characteristic", (_iri(x[0]), k.removesuffix("ObjectProperty") + "Property"))]
    if k == "FunctionalDataProperty":
        return [("characteristic", (_iri(x[0]), "FunctionalProperty"))]
    if all(map(_named, x)):
        if k == "ClassAssertion":
            return [("class_assertion", (_iri(x[0]), x[1]))]
        if k == "SubClassOf":
            return [("sub_class", (_iri(x[0]), _iri(x[1])))]
        if k in ROWS:
            return [(ROWS[k], tuple(map(_iri, x)))]
        if k in PAIRWISE:
            return [(PAIRWISE[k], tuple(map(_iri, p.args))) for p in a.pairwise()]
        if k == "DisjointUnion":
            whole, parts = _iri(x[0]), tuple(map(_iri, x[1:]))
            return [("sub_class", (p, whole)) for p in parts] + [("disjoint_class", tuple(map(_iri, q.args))) for q in Axiom("", parts).pairwise()]
    # a conjunction on the right is its parts
    if k == "SubClassOf" and _named(x[0]) and isinstance(x[1], E.And):
        return [r for part in x[1].of for r in rows_of(Axiom(k, (x[0], part)))]
    shown = [render_dl(y, lambda iri: f"<{iri}>" if ":" in iri else iri) if isinstance(y, E.Node) else f"{'^' if isinstance(y, Prop) and y.inverse else ''}{_iri(y)}" for y in x]
    return [("complex_axiom", (k, shown))]


def _declared(a: Axiom) -> list[tuple[str, tuple]]:
    """Rows that declare what an axiom speaks of, where its kind says what that is."""
    out = []
    if a.kind in ("ClassAssertion", "SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion"):
        for x in a.args:
            if isinstance(x, Class) and x not in (E.THING, E.NOTHING):
                out.append(("entity", (x.iri, "Class")))
    if a.kind == "ClassAssertion":
        out.append(("individuals", (a.args[1],)))
    if a.kind in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
        out.append(("entity", (_iri(a.args[0]), "ObjectProperty" if a.kind[0] == "O" else "DatatypeProperty")))
        out += [("individuals", (x,)) for x in a.args[1:] if isinstance(x, str)]
    return out


def _frames(graph: TripleGraph, rows: list[tuple[str, tuple]]) -> dict[str, DataFrame]:
    by: dict[str, list[tuple]] = {}
    for table, row in rows:
        by.setdefault(table, []).append(row)
    return {t: graph.spark.createDataFrame(r, TABLES[t]) for t, r in by.items()}


def add(graph: TripleGraph, axioms: list[Axiom]) -> TripleGraph:
    """The graph with axioms added; what they speak of is declared with them."""
    rows = [r for a in axioms for r in (*rows_of(a), *_declared(a))]
    return graph.replaced(**{t: graph.table(t).unionByName(df).distinct() for t, df in _frames(graph, rows).items()})


def remove(graph: TripleGraph, axioms: list[Axiom]) -> TripleGraph:
    """The graph without axioms; removing a declaration removes all that is said of the name."""
    gone = [_iri(a.args[1]) for a in axioms if a.kind == "Declaration"]
    out = {}
    for t, df in _frames(graph, [r for a in axioms for r in rows_of(a)]).items():
        out[t] = graph.table(t).join(df, df.columns, "left_anti")
    if gone:
        for t, schema in TABLES.items():
            df = out.get(t, graph.table(t))
            plain = [c.split()[0] for c in schema.split(", ") if c.endswith(" string") and c.split()[0] not in ("lex", "dt", "value", "kind", "name")]
            if plain:
                out[t] = df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*gone), F.lit(False)) for c in plain]))
    return graph.replaced(**out)


def pairwise(groups: DataFrame, members: str = "members") -> DataFrame:
    """``a, b`` for the pairs of each array of members, by position; axioms have few members."""
    first = groups.select(F.col(members).alias("m"), F.posexplode(members).alias("i", "a"))
    return first.select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))

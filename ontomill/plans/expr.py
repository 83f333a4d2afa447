"""Class expressions and data ranges: the logical plan of a query over an ontology.

``Not``, ``And`` and ``Or`` stand for classes and for data ranges alike; a restriction is on data if its filler is a range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

OWL, RDFS, RDF, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"


class Node:
    """Any class expression or data range; ``&``, ``|`` and ``~`` build conjunctions, disjunctions and complements."""

    def __and__(self, other: Node) -> Node:
        return And((self, other))

    def __or__(self, other: Node) -> Node:
        return Or((self, other))

    def __invert__(self) -> Node:
        return negate(self)


@dataclass(frozen=True)
class Class(Node):
    iri: str


THING, NOTHING = Class(OWL + "Thing"), Class(OWL + "Nothing")


@dataclass(frozen=True)
class Prop:
    """An object or data property, or the inverse of an object property."""

    iri: str
    inverse: bool = False

    def flipped(self) -> Prop:
        return Prop(self.iri, not self.inverse)


@dataclass(frozen=True)
class Literal:
    lex: str
    datatype: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True)
class And(Node):
    of: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    of: tuple[Node, ...]


@dataclass(frozen=True)
class Some(Node):
    prop: Prop
    filler: Node = THING


@dataclass(frozen=True)
class All(Node):
    prop: Prop
    filler: Node = THING


@dataclass(frozen=True)
class Card(Node):
    """``op`` is one of ``>=``, ``<=`` and ``=``."""

    op: str
    n: int
    prop: Prop
    filler: Node = THING


@dataclass(frozen=True)
class HasSelf(Node):
    prop: Prop


@dataclass(frozen=True)
class OneOf(Node):
    """Listed individuals."""

    inds: tuple[str, ...]


@dataclass(frozen=True)
class Datatype(Node):
    iri: str


ANY_LITERAL = Datatype(RDFS + "Literal")


@dataclass(frozen=True)
class Values(Node):
    """Listed literals."""

    literals: tuple[Literal, ...]


@dataclass(frozen=True)
class Restricted(Node):
    """A datatype with facets: (name or sign, value), all of which hold."""

    datatype: str
    facets: tuple[tuple[str, str], ...] = field(default=())


def has_value(prop: Prop, value: str | Literal) -> Some:
    return Some(prop, Values((value,)) if isinstance(value, Literal) else OneOf((value,)))


def negate(c: Node) -> Node:
    """The complement, with a double one undone and the constants folded."""
    if isinstance(c, Not):
        return c.of
    return {THING: NOTHING, NOTHING: THING}.get(c) or Not(c) if isinstance(c, Class) else Not(c)


def is_range(c: Node) -> bool:
    """Whether a node is a data range."""
    if isinstance(c, Datatype | Values | Restricted):
        return True
    if isinstance(c, Not):
        return is_range(c.of)
    return isinstance(c, And | Or) and bool(c.of) and all(map(is_range, c.of))


def children(c: Node) -> tuple[Node, ...]:
    if isinstance(c, And | Or):
        return c.of
    if isinstance(c, Not):
        return (c.of,)
    return (c.filler,) if isinstance(c, Some | All | Card) else ()


def signature(c: Node) -> set[str]:
    """IRIs of classes, properties, individuals and datatypes that occur."""
    own = {c.iri} if isinstance(c, Class | Datatype) else {c.prop.iri} if isinstance(c, Some | All | Card | HasSelf) else set(c.inds) if isinstance(c, OneOf) else {c.datatype} if isinstance(c, Restricted) else {x.datatype for x in c.literals} if isinstance(c, Values) else set()
    return own.union(*map(signature, children(c)))


# ---- axioms


@dataclass(frozen=True)
class Axiom:
    """A statement: its kind and its parts, which are IRIs, properties, literals or class expressions.

    ``annotations`` are pairs of property and value.
    """

    kind: str
    args: tuple
    annotations: tuple[tuple[str, str], ...] = ()

    def pairwise(self) -> list[Axiom]:
        """An n-ary statement (equivalence, disjointness, sameness, difference) as statements on pairs."""
        return [Axiom(self.kind, (a, b), self.annotations) for i, a in enumerate(self.args) for b in self.args[i + 1 :]]


#: Kinds of axioms by the box that they belong to, and the number of their arguments (None: any).
KINDS: dict[str, tuple[str, int | None]] = {
    "Declaration": ("T", 2), "DatatypeDefinition": ("T", 2), "HasKey": ("T", None),
    "SubClassOf": ("T", 2), "EquivalentClasses": ("T", None), "DisjointClasses": ("T", None), "DisjointUnion": ("T", None),
    "SubObjectPropertyOf": ("R", 2), "SubDataPropertyOf": ("R", 2), "SubPropertyChainOf": ("R", 2), "InverseObjectProperties": ("R", 2),
    "EquivalentObjectProperties": ("R", None), "EquivalentDataProperties": ("R", None), "DisjointObjectProperties": ("R", None), "DisjointDataProperties": ("R", None),
    "ObjectPropertyDomain": ("T", 2), "ObjectPropertyRange": ("T", 2), "DataPropertyDomain": ("T", 2), "DataPropertyRange": ("T", 2),
    **{f"{k}ObjectProperty": ("R", 1) for k in ("Functional", "InverseFunctional", "Symmetric", "Asymmetric", "Transitive", "Reflexive", "Irreflexive")}, "FunctionalDataProperty": ("R", 1),
    "ClassAssertion": ("A", 2), "ObjectPropertyAssertion": ("A", 3), "DataPropertyAssertion": ("A", 3), "NegativeObjectPropertyAssertion": ("A", 3), "NegativeDataPropertyAssertion": ("A", 3),
    "SameIndividual": ("A", None), "DifferentIndividuals": ("A", None),
    "AnnotationAssertion": ("T", 3), "SubAnnotationPropertyOf": ("T", 2), "AnnotationPropertyDomain": ("T", 2), "AnnotationPropertyRange": ("T", 2),
}


def axiom(kind: str, *args, annotations: tuple = ()) -> Axiom:  # noqa: ANN002
    """An axiom of a known kind with the right number of arguments."""
    if kind not in KINDS:
        raise ValueError(f"no axiom is called {kind}")
    n = KINDS[kind][1]
    if n is not None and len(args) != n or n is None and len(args) < 2:
        raise ValueError(f"{kind} takes {n or 'two or more'} arguments, not {len(args)}")
    return Axiom(kind, args, annotations)

"""Axioms over complex expressions as triples with blank nodes, and back: the OWL 2 mapping to RDF.

Expressions belong to the schema, which is small beside the assertions, so they are read on the driver within ``MOST`` triples;
what is said of individuals (negative assertions, classes of individuals) stays in DataFrames and is joined.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.expr import OWL, RDF, RDFS, XSD, All, And, Card, Class, Datatype, HasSelf, Literal, Node, Not, OneOf, Or, Prop, Restricted, Some, Values
from ontomill.plans.ship import ship
from ontomill.plans.syntax import parse_dl, render_dl

SCHEMA = "s string, p string, o string, o_kind string, dt string, lang string"
#: Triples of expressions that are read at most.
MOST = 2_000_000
#: Predicates by which expressions and lists are built, and those that join two expressions in an axiom.
BUILT = tuple(OWL + x for x in ("onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "hasSelf", "onClass", "onDataRange", "minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality", "complementOf", "datatypeComplementOf", "intersectionOf", "unionOf", "oneOf", "onDatatype", "withRestrictions", "inverseOf", "members", "propertyChainAxiom", "disjointUnionOf", "hasKey")) + (RDF + "first", RDF + "rest", *(XSD + x for x in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "length", "minLength", "maxLength", "pattern", "totalDigits", "fractionDigits")))
AXIOMS = {
    "SubClassOf": RDFS + "subClassOf", "EquivalentClasses": OWL + "equivalentClass", "DisjointClasses": OWL + "disjointWith", "ObjectPropertyDomain": RDFS + "domain", "ObjectPropertyRange": RDFS + "range", "DataPropertyDomain": RDFS + "domain", "DataPropertyRange": RDFS + "range",
    "SubObjectPropertyOf": RDFS + "subPropertyOf", "EquivalentObjectProperties": OWL + "equivalentProperty", "DisjointObjectProperties": OWL + "propertyDisjointWith", "InverseObjectProperties": OWL + "inverseOf",
}
FACETS = {">=": "minInclusive", "<=": "maxInclusive", ">": "minExclusive", "<": "maxExclusive"}
COUNTS = {">=": "min", "<=": "max", "=": ""}


def shown(c: Node) -> str:
    return render_dl(c, lambda iri: f"<{iri}>" if ":" in iri else iri)


class Writer:
    """Triples of one axiom; blank nodes are named by the axiom's own text, so a task that runs again names them alike."""

    def __init__(self, text: str):
        self.base, self.n, self.out = hashlib.md5(text.encode()).hexdigest()[:16], 0, []

    def fresh(self) -> str:
        self.n += 1
        return f"_:e{self.base}x{self.n}"

    def say(self, s: str, p: str, o: str | Literal) -> None:
        if isinstance(o, Literal):
            self.out.append((s, p, o.lex, "lit", o.datatype, None))
        else:
            self.out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))

    def listed(self, items: list) -> str:
        rest = RDF + "nil"
        for item in reversed(items):
            b = self.fresh()
            self.say(b, RDF + "first", item)
            self.say(b, RDF + "rest", rest)
            rest = b
        return rest

    def prop(self, p: Prop) -> str:
        if not p.inverse:
            return p.iri
        b = self.fresh()
        self.say(b, OWL + "inverseOf", p.iri)
        return b

    def node(self, c: Node) -> str:
        if isinstance(c, Class | Datatype):
            return c.iri
        b, data = self.fresh(), E.is_range(c)
        kind = RDFS + "Datatype" if data else OWL + ("Restriction" if isinstance(c, Some | All | Card | HasSelf) else "Class")
        self.say(b, RDF + "type", kind)
        if isinstance(c, And | Or):
            self.say(b, OWL + ("intersectionOf" if isinstance(c, And) else "unionOf"), self.listed([self.node(x) for x in c.of]))
        elif isinstance(c, Not):
            self.say(b, OWL + ("datatypeComplementOf" if data else "complementOf"), self.node(c.of))
        elif isinstance(c, OneOf):
            self.say(b, OWL + "oneOf", self.listed(list(c.inds)))
        elif isinstance(c, Values):
            self.say(b, OWL + "oneOf", self.listed(list(c.literals)))
        elif isinstance(c, Restricted):
            self.say(b, OWL + "onDatatype", c.datatype)
            parts = []
            for name, value in c.facets:
                f = self.fresh()
                self.say(f, XSD + FACETS.get(name, name), Literal(value, c.datatype if name in FACETS else XSD + ("string" if name == "pattern" else "integer")))
                parts.append(f)
            self.say(b, OWL + "withRestrictions", self.listed(parts))
        else:
            self.say(b, OWL + "onProperty", self.prop(c.prop))
            if isinstance(c, HasSelf):
                self.say(b, OWL + "hasSelf", Literal("true", XSD + "boolean"))
            elif isinstance(c, Card):
                whole = c.filler == E.THING
                word = COUNTS[c.op] + ("Cardinality" if whole else "QualifiedCardinality")
                self.say(b, OWL + word[0].lower() + word[1:], Literal(str(c.n), XSD + "nonNegativeInteger"))
                if not whole:
                    self.say(b, OWL + ("onDataRange" if E.is_range(c.filler) else "onClass"), self.node(c.filler))
            else:
                self.say(b, OWL + ("someValuesFrom" if isinstance(c, Some) else "allValuesFrom"), self.node(c.filler))
        return b

    def part(self, text: str) -> str:
        """An argument of an axiom: an expression, a property (with ``^`` if inverse), or a plain name."""
        if text.startswith("^"):
            return self.prop(Prop(text[1:], True))
        if text.startswith("<") and text.endswith(">") and text.count("<") == 1:
            return text[1:-1]
        return self.node(parse_dl(text)) if any(x in text for x in "<(⊓⊔¬∃∀≥≤={ ") else text

    def axiom(self, kind: str, args: list[str]) -> list[tuple]:
        parts = [self.part(x) for x in args]
        if kind == "ClassAssertion":
            self.say(parts[1], RDF + "type", parts[0])
        elif kind == "DisjointUnion":
            self.say(parts[0], OWL + "disjointUnionOf", self.listed(parts[1:]))
        elif kind == "HasKey":
            self.say(parts[0], OWL + "hasKey", self.listed(parts[1:]))
        elif kind == "DisjointClasses" and len(parts) > 2:
            b = self.fresh()
            self.say(b, RDF + "type", OWL + "AllDisjointClasses")
            self.say(b, OWL + "members", self.listed(parts))
        elif kind in AXIOMS:
            first = parts[0]
            for other in parts[1:]:
                self.say(first, AXIOMS[kind], other)
        else:
            raise ValueError(f"{kind} has no triples")
        return self.out


def written(graph) -> DataFrame:  # noqa: ANN001
    """Triples of a graph's complex axioms, property chains and negative assertions."""
    ship(graph.spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, args in zip(batch["kind"], batch["args"], strict=True):
                w = Writer(f"{kind} {list(args)}")
                if kind == "SubPropertyChainOf":
                    w.say(args[0], OWL + "propertyChainAxiom", w.listed([w.part(x) for x in args[1:]]))
                    out += w.out
                else:
                    out += w.axiom(kind, list(args))
            yield pd.DataFrame(out, columns=["s", "p", "o", "o_kind", "dt", "lang"])

    chains = graph.table("prop_chain").select(F.lit("SubPropertyChainOf").alias("kind"), F.concat(F.array("p"), "chain").alias("args"))
    return graph.table("complex_axiom").unionByName(chains).distinct().mapInPandas(rows, SCHEMA).unionByName(_negative(graph))


def _negative(graph) -> DataFrame:  # noqa: ANN001
    null = F.lit(None).cast("string")
    node = F.concat(F.lit("_:n"), F.md5(F.concat_ws("\x1f", "p", "s", "x", F.coalesce("dt", F.lit("")))))
    rows = graph.table("neg_obj_assertion").select("p", "s", F.col("o").alias("x"), null.alias("dt")).unionAll(graph.table("neg_data_assertion").select("p", "s", "lex", "dt")).distinct()
    say = lambda p, o, kind="iri": F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), null.alias("dt"))
    target = F.when(F.col("dt").isNull(), say(OWL + "targetIndividual", F.col("x"))).otherwise(F.struct(F.lit(OWL + "targetValue").alias("p"), F.col("x").alias("o"), F.lit("lit").alias("o_kind"), F.col("dt").alias("dt")))
    said = F.array(say(RDF + "type", F.lit(OWL + "NegativePropertyAssertion")), say(OWL + "sourceIndividual", F.col("s")), say(OWL + "assertionProperty", F.col("p")), target)
    return rows.select(node.alias("s"), F.explode(said).alias("t")).select("s", "t.*", null.alias("lang"))


class Reader:
    """Expressions of blank nodes, from the triples that build them."""

    def __init__(self, rows: list):
        self.said: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for r in rows:
            self.said[r.s][r.p].append(Literal(r.o, r.dt) if r.o_kind == "lit" else r.o)

    def one(self, b: str, *names: str):  # noqa: ANN201
        return next((self.said[b][OWL + n][0] for n in names if OWL + n in self.said[b]), None)

    def items(self, b: str) -> list:
        out = []
        while b in self.said and RDF + "first" in self.said[b]:
            out.append(self.said[b][RDF + "first"][0])
            b = self.said[b][RDF + "rest"][0]
        return out

    def prop(self, x: str) -> Prop:
        inverse = self.one(x, "inverseOf") if x.startswith("_:") else None
        return Prop(inverse, True) if inverse else Prop(x)

    def node(self, x: str) -> Node:
        if not x.startswith("_:"):
            return Datatype(x) if x.startswith(XSD) or x == RDFS + "Literal" else Class(x)
        for name, make in (("intersectionOf", And), ("unionOf", Or)):
            if (found := self.one(x, name)) is not None:
                return make(tuple(map(self.node, self.items(found))))
        if (found := self.one(x, "complementOf", "datatypeComplementOf")) is not None:
            return Not(self.node(found))
        if (found := self.one(x, "oneOf")) is not None:
            items = self.items(found)
            return Values(tuple(items)) if items and isinstance(items[0], Literal) else OneOf(tuple(items))
        if (found := self.one(x, "onDatatype")) is not None:
            back = {v: k for k, v in FACETS.items()}
            facets = [(p.removeprefix(XSD), v[0].lex) for f in self.items(self.one(x, "withRestrictions")) for p, v in self.said[f].items() if p.startswith(XSD)]
            return Restricted(found, tuple((back.get(n, n), v) for n, v in facets))
        on = self.one(x, "onProperty")
        if on is None:
            raise ValueError(f"{x} is no class expression")
        p = self.prop(on)
        if (found := self.one(x, "someValuesFrom", "allValuesFrom")) is not None:
            return (Some if OWL + "someValuesFrom" in self.said[x] else All)(p, self.node(found))
        if (found := self.one(x, "hasValue")) is not None:
            return E.has_value(p, found)
        if self.one(x, "hasSelf") is not None:
            return HasSelf(p)
        for op, word in COUNTS.items():
            plain, qualified = (word + "Cardinality", word + "QualifiedCardinality") if word else ("cardinality", "qualifiedCardinality")
            if (n := self.one(x, plain, qualified)) is not None:
                filler = self.one(x, "onClass", "onDataRange")
                return Card(op, int(n.lex), p, self.node(filler) if filler else E.THING)
        raise ValueError(f"{x} is a restriction of no known kind")

    def text(self, x: str) -> str | None:
        """An argument as ``complex_axiom`` holds it; None if the blank node is no expression (an individual without a name)."""
        if not x.startswith("_:"):
            return x
        if set(self.said[x]) - {RDF + "type"} <= {OWL + "inverseOf"} and OWL + "inverseOf" in self.said[x]:
            return "^" + self.prop(x).iri
        try:
            return shown(self.node(x))
        except ValueError:
            return None


def read(triples: DataFrame, others: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of complex axioms, chains, negative assertions and n-ary disjointness of triples that have blank nodes.

    ``others`` are the graph's tables so far; those that n-ary axioms over plain names add to come back with their rows.
    """
    spark = triples.sparkSession
    kinds = [OWL + x for x in ("AllDisjointClasses", "AllDisjointProperties", "AllDifferent")]
    built = triples.where(F.col("s").startswith("_:") & (F.col("p").isin(*BUILT) | (F.col("p") == OWL + "distinctMembers")) | F.col("p").isin(OWL + "propertyChainAxiom", OWL + "disjointUnionOf", OWL + "hasKey") | (F.col("p") == RDF + "type") & F.col("o").isin(*kinds))
    rows = built.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} triples build class expressions; that isn't a schema")
    r = Reader(rows)
    texts = {b: t for b in list(r.said) if b.startswith("_:") and (t := r.text(b)) is not None}
    known = spark.createDataFrame(sorted(texts.items()), "b string, dl string")
    out: dict[str, list[DataFrame]] = defaultdict(list)
    # axioms between two ends of which one is a blank node
    kind_of = F.create_map(*[F.lit(x) for k, p in AXIOMS.items() if not k.startswith("Data") for x in (p, k)])
    ends = triples.where(F.col("p").isin(*AXIOMS.values()) & (F.col("s").startswith("_:") | (F.col("o_kind") == "bnode")) & ~(F.col("s").startswith("_:") & (F.col("p") == OWL + "inverseOf")))
    properties = F.col("kind").contains("Propert") | F.col("kind").contains("Domain") | F.col("kind").contains("Range")
    ends = ends.withColumn("kind", kind_of[F.col("p")])
    ends = ends.join(F.broadcast(known.withColumnsRenamed({"b": "bs", "dl": "left"})), F.col("s") == F.col("bs"), "left").join(F.broadcast(known.withColumnsRenamed({"b": "bo", "dl": "right"})), F.col("o") == F.col("bo"), "left")
    bare = lambda c, plain: F.when(plain, F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    of_props = F.col("kind").isin("SubObjectPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties")
    args = F.array(F.coalesce("left", bare("s", properties)), F.coalesce("right", bare("o", of_props)))
    out["complex_axiom"].append(ends.where("(left is not null or s not like '\\_:%') and (right is not null or o_kind <> 'bnode')").select("kind", args.alias("args")))
    typed = triples.where((F.col("p") == RDF + "type") & (F.col("o_kind") == "bnode") & ~F.col("s").startswith("_:"))
    out["complex_axiom"].append(typed.join(F.broadcast(known), F.col("o") == F.col("b")).select(F.lit("ClassAssertion").alias("kind"), F.array("dl", "s").alias("args")))
    # lists that hang on a name or on a node of their own
    chains, complexes, pairs = [], [], defaultdict(list)
    arg = lambda x: x if (t := r.text(x)) is None else f"<{t}>" if t == x else t
    for s, said in r.said.items():
        chains += [(s, [r.text(x) for x in r.items(b)]) for b in said.get(OWL + "propertyChainAxiom", ())]
        for b in said.get(OWL + "disjointUnionOf", ()):
            complexes.append(("DisjointUnion", [arg(s), *map(arg, r.items(b))]))
        for b in said.get(OWL + "hasKey", ()):
            complexes.append(("HasKey", [arg(s), *r.items(b)]))
        members = [x for p in ("members", "distinctMembers") for b in said.get(OWL + p, ()) for x in r.items(b)]
        for kind, table in zip(kinds, ("disjoint_class", "disjoint_prop", "different_from"), strict=True):
            if kind in said.get(RDF + "type", ()):
                if any(x.startswith("_:") for x in members):
                    complexes.append(("DisjointClasses", list(map(arg, members))))
                else:
                    pairs[table] += [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]
    if chains:
        out["prop_chain"].append(spark.createDataFrame(chains, "p string, chain array<string>"))
    if complexes:
        out["complex_axiom"].append(spark.createDataFrame(complexes, "kind string, args array<string>"))
    for table, found in pairs.items():
        out[table] += [others[table], spark.createDataFrame(found, "a string, b string")]
    # negative assertions are as many as the data has: by an aggregate over their nodes
    parts = {OWL + x: x for x in ("sourceIndividual", "assertionProperty", "targetIndividual", "targetValue")}
    neg = triples.where(F.col("p").isin(*parts)).groupBy("s").agg(*[F.max(F.when(F.col("p") == p, F.struct("o", "dt"))).alias(name) for p, name in parts.items()])
    neg = neg.select(F.col("assertionProperty.o").alias("p"), F.col("sourceIndividual.o").alias("s"), F.col("targetIndividual.o").alias("o"), F.col("targetValue.o").alias("lex"), F.col("targetValue.dt").alias("dt"))
    out["neg_obj_assertion"].append(neg.where("o is not null").select("p", "s", "o"))
    out["neg_data_assertion"].append(neg.where("o is null").select("p", "s", "lex", "dt"))
    return {table: reduce(DataFrame.unionByName, frames).distinct() for table, frames in out.items()}

"""Complex axioms to triples with blank nodes and back, in every format that is read and written."""

import pytest
from pyspark.sql.types import Row

from ontomill.operators import materialise as M
from ontomill.operators import mutate
from ontomill.plans import expr as E
from ontomill.plans.expr import XSD, All, And, Card, Class, HasSelf, Literal, Not, OneOf, Or, Prop, Restricted, Some, axiom
from ontomill.sources import rdf
from ontomill.sources.graphs import TABLES
from tests.family import graph

NS = "http://x.org/o#"
A, B, C, D = (Class(NS + x) for x in "ABCD")
p, q, d = Prop(NS + "p"), Prop(NS + "q"), Prop(NS + "d")
AXIOMS = [
    axiom("SubClassOf", A, Some(p, B & ~C)), axiom("SubClassOf", And((A, Some(p, B))), D), axiom("EquivalentClasses", A, Or((B, All(q, C)))), axiom("SubClassOf", Some(p.flipped(), E.THING), B), axiom("DisjointClasses", A, Card("<=", 2, p, B)),
    axiom("SubClassOf", A, Card(">=", 3, q)), axiom("SubClassOf", A, HasSelf(p)), axiom("SubClassOf", A, OneOf((NS + "i", NS + "j"))), axiom("EquivalentClasses", C, Some(d, Restricted(XSD + "integer", ((">=", "3"), ("<", "9"))))), axiom("ClassAssertion", Some(p, B), NS + "i"),
    axiom("ObjectPropertyDomain", p, Some(q, E.THING)), axiom("DisjointUnion", D, A, Not(B)), axiom("SubPropertyChainOf", (p, q.flipped()), Prop(NS + "r")), axiom("NegativeObjectPropertyAssertion", p, NS + "i", NS + "j"), axiom("NegativeDataPropertyAssertion", d, NS + "i", Literal("4", XSD + "integer")),
    axiom("AnnotationAssertion", NS + "A", Prop(E.RDFS + "label"), Literal("Ä b", E.RDF + "langString", "de")), axiom("AnnotationAssertion", NS + "A", Prop(E.RDFS + "seeAlso"), NS + "B"), axiom("DataPropertyAssertion", d, NS + "i", Literal("hi", E.RDF + "langString", "en-GB")),
    axiom("DataPropertyAssertion", d, NS + "i", Literal('\b\f\n"\\u0041 $1 \\n', XSD + "string")), axiom("ClassAssertion", A, NS + "k"),
]


def rows(graph):
    return {name: sorted({str(r) for r in graph.table(name).select(*sorted(graph.table(name).columns)).collect()}) for name in TABLES if name not in ("entity", "individuals")}


@pytest.mark.parametrize("fmt", ["nt", "nq", "ttl", "rdf", "trig", "jsonld"])
def test_complex_axioms_come_back(spark, tmp_path, fmt):
    # XML has no form for most control characters
    g = mutate.add(rdf.empty(spark), [a for a in AXIOMS if fmt != "rdf" or "\b" not in str(a.args[-1:]) and "\\x08" not in str(a.args[-1:])])
    at = f"{tmp_path}/g.{fmt}"
    rdf.save(g, at, {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "rdf": "rdfxml"}.get(fmt, fmt))
    want, got = rows(g), rows(rdf.load(spark, at, fmt))
    for table in want:
        assert got[table] == want[table], table


def test_shared_forms_are_read(spark):
    """``AllDisjointClasses``, ``AllDifferent`` and ``hasValue``, which are not written, and individuals without a name, which stay out."""
    text = f"""@prefix : <{NS}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
    [] a owl:AllDisjointClasses ; owl:members ( :A :B :C ) .
    [] a owl:AllDifferent ; owl:distinctMembers ( :i :j ) .
    :D rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:hasValue :i ] .
    :i :p [ a :A ] . :i a :A ."""
    t = spark.createDataFrame([tuple(x) for x in rdf.parse_turtle(text)], rdf.SCHEMA)
    g = rdf.graph_of(t)
    n = lambda x: NS + x
    assert sorted(map(tuple, g.table("disjoint_class").collect())) == [(n("A"), n("B")), (n("A"), n("C")), (n("B"), n("C"))]
    assert g.table("different_from").collect() == [Row(a=n("i"), b=n("j"))]
    assert [r.args for r in g.table("complex_axiom").collect()] == [[f"<{n('D')}>", f"∃ <{n('p')}>.{{<{n('i')}>}}"]]
    assert g.table("obj_assertion").count() == 0 and g.table("class_assertion").count() == 1


def test_complex_axioms_are_reasoned_with(spark):
    g = mutate.add(rdf.empty(spark), [
        axiom("SubClassOf", Some(p, B), A), axiom("SubClassOf", All(p, B), D), axiom("ClassAssertion", B, NS + "y"), axiom("ObjectPropertyAssertion", p, NS + "x", NS + "y"), axiom("SubClassOf", A, C),
        axiom("SubPropertyChainOf", (p, p.flipped()), q), axiom("ObjectPropertyAssertion", p, NS + "z", NS + "y"),
    ])
    full = M.materialise(g)
    types = {(r.cls, r.ind) for r in full.table("class_assertion").collect()}
    assert {(A.iri, NS + "x"), (C.iri, NS + "x"), (A.iri, NS + "z")} <= types and not any(c == D.iri for c, _ in types)
    assert (q.iri, NS + "x", NS + "z") in {tuple(r) for r in full.table("obj_assertion").select("p", "s", "o").collect()}
    for a, holds in ((axiom("ClassAssertion", C, NS + "x"), True), (axiom("ClassAssertion", D, NS + "x"), False), (axiom("SubClassOf", A, C), True), (axiom("SubClassOf", C, A), False), (axiom("ObjectPropertyAssertion", p.flipped(), NS + "y", NS + "x"), True)):
        assert M.is_entailed(g, a) is holds, a


def test_codes_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<u:a> <u:p> "\\U0001F600 \\u00e9 \\\\u0041 \\b\\f\\t\\\\" .\n<u:a> <u:p> "\\u0024\\u0041" .\nbroken\n', encoding="utf-8")
    assert {r.o for r in rdf.read_ntriples(spark, f"{tmp_path}/a.nt").collect()} == {"😀 é \\u0041 \b\f\t\\", "$A"}
    assert [r.value for r in rdf.bad_lines(spark, f"{tmp_path}/a.nt").collect()] == ["broken"]
    with pytest.raises(Exception, match="no statement: broken"):
        rdf.read_ntriples(spark, f"{tmp_path}/a.nt", strict=True).collect()


@pytest.mark.parametrize("fmt, ending", [("turtle", "ttl"), ("rdfxml", "rdf"), ("jsonld", "jsonld"), ("nquads", "nq")])
def test_saved_files_are_read_by_all_tasks_and_once(spark, tmp_path, fmt, ending):
    """A file of statements by lines is split among tasks, and the loaded graph's tables don't read it again."""
    odd = ["a & <b> 'c' \"d\"", "x\ry\nz\\", "]]> {} . # <u:p>", "   é😀"]
    rows = [("u:p#q", f"u:s{i}", odd[i % 4] + str(i), XSD + "string") for i in range(400)]
    g = graph(spark, data_assertion=rows, obj_assertion=[("u:l", "u:s'1", "u:o&2")])
    at = f"{tmp_path}/{fmt}"
    rdf.save(g.replaced(data_assertion=g.table("data_assertion").coalesce(1)), at, fmt)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        t = rdf.read_triples(spark, at, ending)
        assert t.rdd.getNumPartitions() > len([f for f in (tmp_path / fmt).iterdir() if f.name.startswith("part-")])
        back = rdf.triples_of(rdf.load(spark, at, ending))
        assert not any(at in f for f in back.inputFiles())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rdf.triples_of(g).collect()}


def test_blocks_of_many_statements_lose_none(spark, tmp_path):
    """A TriG block with two statements in one line is no line that stands by itself."""
    (tmp_path / "a.trig").write_text("GRAPH <u:g> { <u:a> <u:p> <u:b> . <u:c> <u:p> <u:d> . }\n")
    assert {(r.s, r.o) for r in rdf.read_triples(spark, f"{tmp_path}/a.trig").collect()} == {("u:a", "u:b"), ("u:c", "u:d")}

import random

import duckdb
import pytest

from ontomill.operators.retrieval import Reasoner
from ontomill.plans import algebra, expr as E
from ontomill.plans.expr import XSD, All, And, Card, Class, HasSelf, Literal, OneOf, Or, Prop, Restricted, Some, Values
from ontomill.plans.sparql import to_sparql, to_sql
from ontomill.plans.syntax import parse_dl, parse_manchester, render_dl, render_manchester
from tests.family import BIRTHS, CHILDREN, NS, PEOPLE, father, n
from tests.naive import Naive


@pytest.fixture(scope="module")
def kg(spark):
    return father(spark)


@pytest.fixture(scope="module")
def naive():
    types = [(n(c), n(p)) for c in ("female", "person") for p in ("anna", "michelle")] + [(n(c), n(p)) for c in ("male", "person") for p in ("heinz", "markus", "martin", "stefan")]
    links = [(n("hasChild"), n(a), n(b)) for a, b in CHILDREN] + [(n("hasParent"), n(b), n(a)) for a, b in CHILDREN]
    values = [(n("birthDate"), n(a), d, XSD + "date") for a, d in BIRTHS] + [(n("size"), n("anna"), "170", XSD + "integer"), (n("size"), n("anna"), "1.7", XSD + "double"), (n("size"), n("stefan"), "NaN", XSD + "double"), (n("size"), n("heinz"), "180", XSD + "integer")]
    return Naive([n(p) for p in PEOPLE], types, links, values)


def names(df):
    return {r.ind.removeprefix(NS) for r in df.collect()}


GOLDEN = {
    "female": "anna michelle", "male ⊓ ∃ hasChild.female": "markus", "female ⊓ ∃ hasChild.⊤": "anna", "∃ hasChild.(∃ hasChild.(∃ hasChild.⊤))": "stefan", "∃ hasChild.{heinz}": "anna martin",
    "{anna ⊔ michelle ⊔ markus}": "anna michelle markus", "¬female": "heinz markus martin stefan", "∀ hasChild.⊥": "heinz michelle", "∃ hasParent⁻.⊤": "anna markus martin stefan", "person": "anna heinz markus martin michelle stefan",
    "∃ birthDate.xsd:date[> 1995-06-12 ⊓ < 1999-03-02]": "martin", "= 0 hasChild.⊤": "heinz michelle", "≥ 2 hasChild⁻.⊤": "heinz", "∃ size.xsd:double[> 1.0]": "anna", "∃ size.(¬xsd:integer)": "anna stefan", "≥ 2 size.rdfs:Literal": "anna",
}


def test_golden(kg):
    r = Reasoner(kg)
    for dl, want in GOLDEN.items():
        got = r.instances(parse_dl(dl, NS)).collect()
        assert {x.ind.removeprefix(NS) for x in got} == set(want.split()), dl
        assert len(got) == len(want.split())


def test_open_world_and_compat(kg):
    assert names(Reasoner(kg, closed=False).instances(parse_dl("¬(∃ hasChild.⊤)", NS))) == set()
    assert names(Reasoner(kg, subs=False).instances(parse_dl("person", NS))) == set()
    # anna has an integer and a double: by value she has a non-integer, by subject not
    assert names(Reasoner(kg, compat=True).instances(parse_dl("∃ size.(¬xsd:integer)", NS))) == {"stefan"}


def generated(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([Class(n("male")), Class(n("female")), Class(n("person")), E.THING, E.NOTHING, OneOf((n("anna"), n("heinz"))), OneOf((n("nobody"),))])
    kind = rng.randrange(9)
    sub = lambda: generated(rng, depth - 1)
    prop = Prop(n(rng.choice(["hasChild", "hasParent"])), rng.random() < 0.3)
    if kind < 2:
        return (And if kind else Or)((sub(), sub()))
    if kind == 2:
        return E.negate(sub())
    if kind < 5:
        return (Some if kind == 3 else All)(prop, sub())
    if kind == 5:
        return Card(rng.choice([">=", "<=", "="]), rng.randrange(3), prop, sub())
    if kind == 6:
        return HasSelf(prop)
    data = rng.choice([Restricted(XSD + "integer", ((rng.choice([">", "<="]), "175"),)), Restricted(XSD + "date", ((">=", "1995-06-12"), ("<", "1999-03-02"))), Values((Literal("180", XSD + "integer"), Literal("1.7", XSD + "double"))), E.Datatype(XSD + "double"), E.ANY_LITERAL, Restricted(XSD + "double", (("<", "100.0"),))])
    data = rng.choice([data, E.Not(data), And((data, E.ANY_LITERAL)), Or((data, E.Datatype(XSD + "date")))])
    p = Prop(n(rng.choice(["size", "birthDate"])))
    return rng.choice([Some(p, data), All(p, data), Card(rng.choice([">=", "<=", "="]), rng.randrange(3), p, data)])


def test_rewrites_keep_the_meaning(naive):
    rng = random.Random(1)
    for _ in range(1500):
        c = generated(rng, 4)
        want = naive(c)
        assert naive(algebra.nnf(c)) == want, c
        assert naive(algebra.simplify(c)) == want, (c, algebra.simplify(c))
        assert naive(algebra.nnf(E.negate(c))) == naive.u - want
        if algebra.length(c) < 25:
            assert naive(algebra.dnf(c)) == want and naive(algebra.cnf(c)) == want
        assert algebra.length(algebra.simplify(c)) <= algebra.length(algebra.flat(algebra.nnf(c)))


def test_round_trips():
    rng = random.Random(2)
    for _ in range(800):
        c = generated(rng, 4)
        short = lambda i: i.removeprefix(NS) if i.startswith(NS) else f"<{i}>"
        flat = algebra.flat(c)
        for render, parse in ((render_dl, parse_dl), (render_manchester, parse_manchester)):
            text = render(flat, short)
            assert algebra.flat(parse(text, NS)) == flat, text


def test_generated_against_naive_and_sql(kg, naive):
    rng = random.Random(3)
    c = duckdb.connect()
    for table, columns, rows in (("universe", "ind", [(i,) for i in naive.u]), ("types", "cls, ind", naive.types), ("links", "p, s, o", naive.links), ("vals", "p, s, lex, dt", naive.values)):
        c.sql(f"CREATE TABLE {table} AS SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) t({columns})")
    for _ in range(400):
        ce = generated(rng, 3)
        got = c.sql(to_sql(ce)).fetchall()
        assert {x for (x,) in got} == naive(ce), to_sql(ce)
        assert to_sparql(ce).startswith("SELECT DISTINCT ?x WHERE {")
    r = Reasoner(kg)
    for _ in range(12):
        ce = generated(rng, 3)
        got = [x.ind for x in r.instances(ce).collect()]
        assert set(got) == naive(ce) and len(got) == len(set(got)), ce


def test_laws():
    a, b = Class("a"), Class("b")
    r = Prop("r")
    assert algebra.simplify(Or((a, E.Not(a), b))) == E.THING
    assert algebra.simplify(And((a, E.Not(a)))) == E.NOTHING
    assert algebra.simplify(Or((a, And((a, b))))) == a
    assert algebra.simplify(Or((Some(r, a), Some(r, b)))) == Some(r, Or((a, b)))
    assert algebra.simplify(E.Not(Card(">=", 0, r, a))) == E.NOTHING
    assert algebra.simplify(Or((And((a, b)), And((a, Class("c")))))) == And((a, Or((b, Class("c")))))
    assert to_sparql(Some(r, a), counted=True).startswith("SELECT (COUNT(DISTINCT ?x)")
    assert len(list(algebra.combinations([a, b], lambda x, y: Or((x, y))))) == 2
    assert len(list(algebra.restrictions([a, b], [r]))) == 2


def test_navigation(kg):
    r = Reasoner(kg)
    assert {x.o for x in r.object_property_values(n("heinz"), Prop(n("hasChild"), True)).collect()} == {n("anna"), n("martin")}
    assert r.data_property_values(n("size"), n("anna")).count() == 2
    assert {x.cls for x in r.types(n("anna"), [n("male"), n("female"), n("person")]).collect()} == {n("female"), n("person")}
    assert r.count(parse_dl("male", NS)).first().n == 4
    assert names(r.among(parse_dl("male", NS), kg.table("individuals").limit(6))) == {"heinz", "markus", "martin", "stefan"}

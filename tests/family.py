"""A small family: three classes, one property, six people; and a wider graph for generated expressions."""

from ontomill.plans.expr import XSD
from ontomill.sources.graphs import TABLES, TripleGraph

NS = "http://example.com/father#"


def n(x):
    return NS + x


def graph(spark, **rows):
    return TripleGraph(spark, {t: spark.createDataFrame(r, TABLES[t]) for t, r in rows.items()})


PEOPLE = ["anna", "heinz", "markus", "martin", "michelle", "stefan"]
CHILDREN = [("stefan", "markus"), ("markus", "anna"), ("anna", "heinz"), ("martin", "heinz")]
BIRTHS = [("markus", "1990-01-01"), ("anna", "1995-06-12"), ("heinz", "1999-03-02"), ("michelle", "1980-05-05"), ("martin", "1997-07-07")]


def father(spark):
    return graph(
        spark,
        individuals=[(n(p),) for p in PEOPLE],
        class_assertion=[(n("female"), n(p)) for p in ("anna", "michelle")] + [(n("male"), n(p)) for p in ("heinz", "markus", "martin", "stefan")],
        sub_class=[(n("male"), n("person")), (n("female"), n("person"))],
        obj_assertion=[(n("hasChild"), n(a), n(b)) for a, b in CHILDREN],
        inverse_prop=[(n("hasChild"), n("hasParent"))],
        data_assertion=[(n("birthDate"), n(a), d, XSD + "date") for a, d in BIRTHS] + [(n("size"), n("anna"), "170", XSD + "integer"), (n("size"), n("anna"), "1.7", XSD + "double"), (n("size"), n("stefan"), "NaN", XSD + "double"), (n("size"), n("heinz"), "180", XSD + "integer")],
        entity=[(n(c), "Class") for c in ("person", "male", "female")] + [(n("hasChild"), "ObjectProperty")],
    )

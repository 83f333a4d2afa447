"""Registered queries for the services beside retrieval: scans, hierarchies, formats, normal forms, embeddings, edits, scalars."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.functions import text as T
from ontomill.operators import materialise, metrics, mutate
from ontomill.operators.embedding import SUB, TYPE, EmbeddingGraph
from ontomill.operators.retrieval import Reasoner
from ontomill.operators.schema import Schema
from ontomill.plans import algebra
from ontomill.plans import expr as E
from ontomill.plans.expr import OWL, RDF, RDFS, XSD, Class, Literal, Node, Prop, axiom
from ontomill.plans.rounds import checkpoint_dir
from ontomill.plans.sparql import to_sparql, to_sql
from ontomill.plans.syntax import parse_dl, parse_manchester, render_dl, render_manchester
from ontomill.sources import rdf, tabular
from ontomill.sources.market import BALANCE, BOUGHT_BY, BUYS, DOCUMENT, NS, ORDERED, PLACE, PRODUCT, market_graph
from ontomill.sources.market import SQL as MARKET
from ontomill.sources.star import star_graph
from ontomill.sources.star_triples import star_triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FRANCE = f"{NS}nation.NATION_6"


def query(sql: str, market: bool = True) -> Callable:
    """Registers a function under its name, with its SQL (over the market graph's views unless said otherwise)."""

    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH RECURSIVE {MARKET} {sql}" if market else sql
        return f

    return take


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _schema(spark: SparkSession, sf_dir: str) -> Schema:
    return Schema(market_graph(spark, sf_dir))


# ---- scans

CLASSES = f"SELECT sub AS iri FROM sub_class UNION SELECT sup FROM sub_class UNION SELECT b FROM equivalent_class UNION SELECT '{DOCUMENT}'"
OBJECT_PROPERTIES = f"SELECT sub AS iri FROM sub_prop UNION SELECT unnest(['{BUYS}', '{ORDERED}', '{BOUGHT_BY}', '{BUYS}_1-URGENT', '{BUYS}_5-LOW'])"
INDIVIDUALS = "SELECT ind AS iri FROM class_assertion UNION SELECT s FROM links UNION SELECT o FROM links UNION SELECT s FROM data_assertion"


@query(CLASSES)
def class_scan(spark, sf_dir):
    """Classes of every kind of axiom and assertion."""
    return _schema(spark, sf_dir).classes()


@query(OBJECT_PROPERTIES)
def object_property_scan(spark, sf_dir):
    return _schema(spark, sf_dir).properties("object")


@query(f"SELECT '{BALANCE}' AS iri WHERE EXISTS (SELECT 1 FROM data_assertion)")
def data_property_scan(spark, sf_dir):
    return _schema(spark, sf_dir).properties("data")


@query(INDIVIDUALS)
def individual_scan(spark, sf_dir):
    return market_graph(spark, sf_dir).universe_frame().withColumnRenamed("ind", "iri")


@query(f"{CLASSES} UNION {OBJECT_PROPERTIES} UNION SELECT '{BALANCE}' UNION {INDIVIDUALS}")
def signature(spark, sf_dir):
    return _schema(spark, sf_dir).signature()


@query("SELECT 'A' AS box, (SELECT count(*) FROM class_assertion) + (SELECT count(*) FROM links) + (SELECT count(*) FROM data_assertion) + (SELECT count(*) FROM same_as) + (SELECT count(*) FROM different_from) AS n UNION ALL SELECT 'T', (SELECT count(*) FROM sub_class) + (SELECT count(*) FROM equivalent_class) + (SELECT count(*) FROM disjoint_class) + 2 UNION ALL SELECT 'R', (SELECT count(*) FROM sub_prop) + 4")
def statements_by_box(spark, sf_dir):
    return spark.createDataFrame(sorted(_schema(spark, sf_dir).boxes().items()), "box string, n long")


@query(
    f"""SELECT 'SubClassOf(<' || sub || '> <' || sup || '>)' AS value FROM sub_class UNION ALL SELECT 'EquivalentClasses(<' || a || '> <' || b || '>)' FROM equivalent_class
    UNION ALL SELECT 'DisjointClasses(<' || a || '> <' || b || '>)' FROM disjoint_class UNION ALL SELECT 'SubObjectPropertyOf(<' || sub || '> <' || sup || '>)' FROM sub_prop
    UNION ALL SELECT 'SameIndividual(<' || a || '> <' || b || '>)' FROM same_as UNION ALL SELECT 'DifferentIndividuals(<' || a || '> <' || b || '>)' FROM different_from
    UNION ALL SELECT 'ClassAssertion(<' || cls || '> <' || ind || '>)' FROM class_assertion UNION ALL SELECT 'ObjectPropertyAssertion(<' || p || '> <' || s || '> <' || o || '>)' FROM links
    UNION ALL SELECT 'DataPropertyAssertion(<' || p || '> <' || s || '> "' || lex || '"^^<' || dt || '>)' FROM data_assertion
    UNION ALL SELECT unnest(['EquivalentObjectProperties(<{BUYS}> <{ORDERED}>)', 'DisjointObjectProperties(<{BUYS}_1-URGENT> <{BUYS}_5-LOW>)', 'InverseObjectProperties(<{BUYS}> <{BOUGHT_BY}>)', 'ObjectPropertyDomain(<{BUYS}> <{PLACE}>)', 'ObjectPropertyRange(<{BUYS}> <{DOCUMENT}>)'])"""
)
def axiom_scan(spark, sf_dir):
    """Every axiom as a row, in functional notation."""
    return rdf.axiom_lines(market_graph(spark, sf_dir), "functional")


# ---- formats

_TRIPLES = f"""SELECT sub AS s, '{RDFS}subClassOf' AS p, sup AS o FROM sub_class UNION ALL SELECT sub, '{RDFS}subPropertyOf', sup FROM sub_prop UNION ALL SELECT a, '{OWL}equivalentClass', b FROM equivalent_class
UNION ALL SELECT a, '{OWL}disjointWith', b FROM disjoint_class UNION ALL SELECT a, '{OWL}sameAs', b FROM same_as UNION ALL SELECT a, '{OWL}differentFrom', b FROM different_from UNION ALL SELECT ind, '{RDF}type', cls FROM class_assertion
UNION ALL SELECT s, p, o FROM links UNION ALL SELECT s, p, lex FROM data_assertion UNION ALL SELECT s, p, value FROM annotation
UNION ALL SELECT unnest(['{BUYS}', '{BUYS}_1-URGENT', '{BUYS}', '{BUYS}', '{BUYS}', '{BUYS}']), unnest(['{OWL}equivalentProperty', '{OWL}propertyDisjointWith', '{OWL}inverseOf', '{RDFS}domain', '{RDFS}range', '{RDF}type']), unnest(['{ORDERED}', '{BUYS}_5-LOW', '{BOUGHT_BY}', '{PLACE}', '{DOCUMENT}', '{OWL}AsymmetricProperty'])"""


def _round_trip(spark: SparkSession, sf_dir: str, fmt: str, ending: str) -> DataFrame:
    at = f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}.{ending}"
    rdf.save(market_graph(spark, sf_dir), at, fmt)
    return rdf.triples_of(rdf.load(spark, at, ending)).select("s", "p", "o")


@query(_TRIPLES)
def saved_ntriples(spark, sf_dir):
    """A graph written and loaded again."""
    return _round_trip(spark, sf_dir, "ntriples", "nt")


@query(_TRIPLES)
def saved_nquads(spark, sf_dir):
    return _round_trip(spark, sf_dir, "nquads", "nq")


@query(_TRIPLES)
def saved_turtle(spark, sf_dir):
    return _round_trip(spark, sf_dir, "turtle", "ttl")


@query(_TRIPLES)
def saved_rdfxml(spark, sf_dir):
    return _round_trip(spark, sf_dir, "rdfxml", "rdf")


@query(_TRIPLES)
def saved_trig(spark, sf_dir):
    return _round_trip(spark, sf_dir, "trig", "trig")


@query(_TRIPLES)
def saved_jsonld(spark, sf_dir):
    return _round_trip(spark, sf_dir, "jsonld", "jsonld")


@query("SELECT 0::BIGINT AS n", market=False)
def empty_graph(spark, sf_dir):
    """A graph made empty has no triple."""
    return rdf.triples_of(rdf.empty(spark)).agg(F.count("*").alias("n"))


@query("SELECT 'u:in' AS p, 'u:' || replace(n_name, ' ', '_') AS s, 'u:' || replace(r_name, ' ', '_') AS o, '' AS dt FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'u:number', 'u:' || replace(r_name, ' ', '_'), r_regionkey::VARCHAR, 'http://www.w3.org/2001/XMLSchema#integer' FROM region", market=False)
def json_quadruples(spark, sf_dir):
    """Statements whose objects are subjects become links, the others literals of a guessed type."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    q = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"))
    g = tabular.quadruples_to_graph(q.unionAll(region.select("r_name", F.lit("number"), F.col("r_regionkey").cast("string"))), "u:")
    return g.table("obj_assertion").select("p", "s", "o", F.lit("").alias("dt")).unionAll(g.table("data_assertion").select("p", "s", "lex", "dt"))


# ---- hierarchies and declared facts

_STRICT = "strict AS (SELECT sub, sup FROM above a WHERE sub <> sup AND NOT EXISTS (SELECT 1 FROM above b WHERE b.sub = a.sup AND b.sup = a.sub)), covers AS (SELECT sub, sup FROM strict EXCEPT SELECT a.sub, b.sup FROM strict a JOIN strict b ON a.sup = b.sub)"


@query(f", {_STRICT} SELECT sub AS item FROM covers WHERE sup = '{PLACE}'".lstrip(", ").join([", ", ""]))
def direct_children(spark, sf_dir):
    return _schema(spark, sf_dir).sub_classes(PLACE, direct=True)


@query(f", {_STRICT} SELECT sup AS item FROM covers WHERE sub = '{FRANCE}'")
def direct_parents(spark, sf_dir):
    return _schema(spark, sf_dir).super_classes(FRANCE, direct=True)


@query(f", {_STRICT} SELECT DISTINCT sub AS item FROM covers WHERE sub <> '{FRANCE}' AND sup IN (SELECT sup FROM covers WHERE sub = '{FRANCE}')")
def siblings(spark, sf_dir):
    return _schema(spark, sf_dir).class_hierarchy().siblings(FRANCE)


@query(f", {_STRICT} SELECT iri AS item FROM ({CLASSES}) WHERE iri NOT IN (SELECT sub FROM strict)")
def hierarchy_roots(spark, sf_dir):
    return _schema(spark, sf_dir).class_hierarchy().roots()


@query(f", {_STRICT} SELECT iri AS item FROM ({CLASSES}) WHERE iri NOT IN (SELECT sup FROM strict)")
def hierarchy_leaves(spark, sf_dir):
    return _schema(spark, sf_dir).class_hierarchy().leaves()


@query(f", kept AS (SELECT nation AS item FROM nat UNION SELECT '{PLACE}') SELECT DISTINCT sub, sup FROM above WHERE sub <> sup AND sub IN (SELECT item FROM kept) AND sup IN (SELECT item FROM kept)")
def restricted_hierarchy(spark, sf_dir):
    """The hierarchy among nations and the top of places, over the regions in between."""
    s = _schema(spark, sf_dir)
    keep = s.classes().where(F.col("iri").startswith(f"{NS}nation.") | (F.col("iri") == PLACE)).withColumnRenamed("iri", "item")
    return s.class_hierarchy().restricted(keep).closure.where("sub <> sup")


@query(f"SELECT a AS iri FROM equivalent_class WHERE b = '{NS}code.6'")
def equivalent_classes(spark, sf_dir):
    return _schema(spark, sf_dir).equivalent_classes(f"{NS}code.6")


@query("SELECT a AS iri FROM different_from WHERE b = (SELECT max(b) FROM different_from) UNION SELECT b FROM different_from WHERE a = (SELECT max(b) FROM different_from)")
def different_individuals(spark, sf_dir):
    g = market_graph(spark, sf_dir)
    last = g.table("different_from").agg(F.max("b")).first()[0]
    return Schema(g).different_individuals(last)


@query(f"SELECT b AS iri FROM same_as WHERE a = '{NS}customer.3'")
def same_individuals(spark, sf_dir):
    return _schema(spark, sf_dir).same_individuals(f"{NS}customer.3")


@query(f"SELECT '{ORDERED}' AS iri", market=False)
def equivalent_properties(spark, sf_dir):
    return _schema(spark, sf_dir).equivalent_properties(BUYS)


@query(f"SELECT '{BUYS}_5-LOW' AS iri", market=False)
def disjoint_properties(spark, sf_dir):
    return _schema(spark, sf_dir).disjoint_properties(f"{BUYS}_1-URGENT")


@query(f", hit AS (SELECT b AS iri FROM disjoint_class WHERE a IN (SELECT sup FROM above WHERE sub = '{FRANCE}' UNION SELECT '{FRANCE}') UNION SELECT a FROM disjoint_class WHERE b IN (SELECT sup FROM above WHERE sub = '{FRANCE}' UNION SELECT '{FRANCE}')) SELECT iri FROM hit UNION SELECT sub FROM above WHERE sup IN (SELECT iri FROM hit)")
def disjoint_by_data(spark, sf_dir):
    """Classes disjoint with a nation: other regions, what is below or equal to them, and products."""
    return _schema(spark, sf_dir).disjoint_classes(FRANCE)


@query(f"SELECT sub AS item FROM sub_prop UNION SELECT '{ORDERED}'")
def object_property_hierarchy(spark, sf_dir):
    return _schema(spark, sf_dir).property_hierarchy("object").children(BUYS, direct=False)


@query(f"SELECT unnest(['{BUYS}', '{ORDERED}']) AS item", market=False)
def property_roots(spark, sf_dir):
    """Object properties that none lies strictly above, among those of the hierarchy."""
    h = _schema(spark, sf_dir).property_hierarchy("object")
    return h.roots().where(F.col("item") != BOUGHT_BY)


@query(f"SELECT '{DOCUMENT}' AS iri", market=False)
def property_range(spark, sf_dir):
    return _schema(spark, sf_dir).ranges(f"{BUYS}_5-LOW")


@query(f"SELECT '{PLACE}' AS iri", market=False)
def property_domain(spark, sf_dir):
    return _schema(spark, sf_dir).domains(f"{BUYS}_5-LOW")


@query(f"SELECT DISTINCT p FROM links WHERE s = '{NS}customer.3'")
def object_properties_of(spark, sf_dir):
    return _schema(spark, sf_dir).properties_of(f"{NS}customer.3")


# ---- reasoning


@query(f"SELECT DISTINCT ind, sup AS cls FROM class_assertion JOIN above ON cls = sub UNION SELECT ind, cls FROM class_assertion UNION SELECT s, '{PLACE}' FROM links UNION SELECT o, '{DOCUMENT}' FROM links UNION SELECT b, cls FROM same_as JOIN class_assertion ON a = ind UNION SELECT b, sup FROM same_as JOIN class_assertion ON a = ind JOIN above ON cls = sub UNION SELECT b, '{PLACE}' FROM same_as JOIN links ON a = s")
def materialised_market(spark, sf_dir):
    """Types by subclasses, equivalences, a domain and a range over sub-properties, and sameness."""
    return materialise.materialise(market_graph(spark, sf_dir)).table("class_assertion").select("ind", "cls")


_PLANTED = f"""SELECT 'disjoint classes' AS rule, ind AS subject FROM class_assertion JOIN above ON cls = sub WHERE sup = '{PRODUCT}' AND ind IN (SELECT '{NS}part.' || p_partkey FROM part WHERE p_size = 7)
UNION SELECT 'negative assertion', s FROM links WHERE p = '{BUYS}_2-HIGH' UNION SELECT 'same and different', a FROM same_as UNION SELECT 'same and different', b FROM same_as
UNION SELECT 'irreflexive', s FROM links WHERE p = '{BUYS}_1-URGENT' UNION SELECT 'asymmetric', s FROM links WHERE p = '{BUYS}_3-MEDIUM' UNION SELECT 'asymmetric', o FROM links WHERE p = '{BUYS}_3-MEDIUM'
UNION SELECT 'disjoint properties', s FROM links WHERE p = '{BUYS}_5-LOW' UNION SELECT 'nothing', '{NS}supplier.' || s_suppkey FROM supplier WHERE s_nationkey = 4"""


@query(_PLANTED)
def planted_inconsistencies(spark, sf_dir):
    """Contradictions of every rule, planted from the data, and found in the classes closed upwards."""
    g = market_graph(spark, sf_dir)
    types, links = g.table("class_assertion"), g.table("obj_assertion")
    up = g.closure("sub_class")
    types = types.unionByName(types.join(up, F.col("cls") == F.col("sub")).select(F.col("sup").alias("cls"), "ind"))
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    wrong = part.where("p_size = 7").select(F.lit(PLACE).alias("cls"), F.concat(F.lit(f"{NS}part."), F.col("p_partkey").cast("string")).alias("ind"))
    none = supplier.where("s_nationkey = 4").select(F.lit(E.NOTHING.iri).alias("cls"), F.concat(F.lit(f"{NS}supplier."), F.col("s_suppkey").cast("string")).alias("ind"))
    of = lambda priority: links.where(F.col("p") == f"{BUYS}_{priority}")
    loops = of("1-URGENT").select(F.lit("u:loop").alias("p"), "s", F.col("s").alias("o"))
    one_way = of("3-MEDIUM").select(F.lit("u:way").alias("p"), "s", "o").unionByName(of("3-MEDIUM").select(F.lit("u:way").alias("p"), F.col("o").alias("s"), F.col("s").alias("o")))
    twice = of("5-LOW").select(F.lit("u:twice").alias("p"), "s", "o")
    same = g.table("same_as")
    bad = g.replaced(
        class_assertion=types.unionByName(wrong).unionByName(none), obj_assertion=links.unionByName(loops).unionByName(one_way).unionByName(twice), neg_obj_assertion=of("2-HIGH"),
        characteristic=spark.createDataFrame([("u:loop", "IrreflexiveProperty"), ("u:way", "AsymmetricProperty")], "p string, name string"), disjoint_class=spark.createDataFrame([(PLACE, PRODUCT)], "a string, b string"),
        disjoint_prop=spark.createDataFrame([(f"{BUYS}_5-LOW", "u:twice")], "a string, b string"), different_from=same.unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))),
    )
    return materialise.inconsistencies(bad)


@query(", both_of AS (SELECT a.sub FROM above a JOIN above b ON a.sub = b.sub JOIN disjoint_class d ON a.sup = d.a AND b.sup = d.b) SELECT DISTINCT '" + NS + "mixed.' || substr(nation, 14) AS iri FROM nat WHERE region <> (SELECT max(region) FROM nat) UNION SELECT sub FROM both_of")
def unsatisfiable_classes(spark, sf_dir):
    """Classes below a nation and the last region: all but those of nations of that region."""
    g = market_graph(spark, sf_dir)
    regions = g.table("sub_class").where(F.col("sup") == PLACE).select(F.max("sub").alias("last"))
    nations = g.table("equivalent_class").select(F.col("a").alias("nation"))
    mixed = nations.select(F.concat(F.lit(f"{NS}mixed."), F.expr("substring(nation, 14)")).alias("sub"), F.col("nation").alias("sup"))
    last = mixed.select("sub").crossJoin(F.broadcast(regions)).select("sub", F.col("last").alias("sup"))
    return materialise.unsatisfiable_classes(g.replaced(sub_class=g.table("sub_class").unionByName(mixed).unionByName(last)))


@query(f"SELECT 'InferredEquivalentObjectPropertyAxiomGenerator' AS kind, '' AS a, '' AS b WHERE false UNION ALL SELECT 'InferredSubObjectPropertyAxiomGenerator', sub, '{ORDERED}' FROM sub_prop UNION ALL SELECT 'InferredSubObjectPropertyAxiomGenerator', unnest(['{BUYS}', '{ORDERED}']), unnest(['{ORDERED}', '{BUYS}']) UNION ALL SELECT 'InferredInverseObjectPropertiesAxiomGenerator', '{BOUGHT_BY}', '{BUYS}' UNION ALL SELECT DISTINCT 'InferredSubClassAxiomGenerator', sub, sup FROM above WHERE sub <> sup AND (sub, sup) NOT IN (SELECT (sub, sup) FROM sub_class)")
def inferred_schema(spark, sf_dir):
    """Inferred axioms of several generators."""
    g = market_graph(spark, sf_dir)
    kinds = ("InferredSubClassAxiomGenerator", "InferredInverseObjectPropertiesAxiomGenerator", "InferredSubObjectPropertyAxiomGenerator", "InferredEquivalentObjectPropertyAxiomGenerator")
    declared = spark.createDataFrame([(x, "ObjectProperty") for x in (BUYS, ORDERED, BOUGHT_BY)], "iri string, kind string")
    return materialise.inferred(g.replaced(entity=declared), kinds)


@query(f", RECURSIVE_PATHS AS (SELECT 1) SELECT '{FRANCE}' || ' ' || region || ' ' || '{PLACE}' AS path FROM nat WHERE nation = '{FRANCE}'")
def subclass_justifications(spark, sf_dir):
    """The minimal sets of subclass axioms that put a nation below places."""
    found = materialise.justifications(market_graph(spark, sf_dir), FRANCE, PLACE)
    return spark.createDataFrame([(" ".join([p[0][0], *(b for _, b in p)]),) for p in found], "path string")


# ---- expressions rewritten

_BIG = "Customer ⊓ ¬(BuildingCustomer ⊓ ∀ placed.¬UrgentOrder)"
_BIG_SQL = "SELECT 'customer/' || c_custkey AS ind FROM customer WHERE c_mktsegment <> 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


def _rewritten(spark: SparkSession, sf_dir: str, rewrite: Callable[[Node], Node]) -> DataFrame:
    r = Reasoner(star_graph(spark, sf_dir))
    return r.named(r.sets(rewrite(parse_dl(_BIG))))


@query(_BIG_SQL, market=False)
def negation_normal_form(spark, sf_dir):
    return _rewritten(spark, sf_dir, algebra.nnf)


@query(_BIG_SQL, market=False)
def conjunctive_normal_form(spark, sf_dir):
    return _rewritten(spark, sf_dir, algebra.cnf)


@query(_BIG_SQL, market=False)
def disjunctive_normal_form(spark, sf_dir):
    return _rewritten(spark, sf_dir, algebra.dnf)


@query(_BIG_SQL, market=False)
def simplified_expression(spark, sf_dir):
    return _rewritten(spark, sf_dir, lambda c: algebra.simplify(c & c & (c | parse_dl("Customer"))))


@query(_BIG_SQL, market=False)
def flattened_expression(spark, sf_dir):
    return _rewritten(spark, sf_dir, lambda c: algebra.flat(c & (c & c)))


@query(_BIG_SQL, market=False)
def rendered_expression(spark, sf_dir):
    """Written and parsed in both notations."""
    return _rewritten(spark, sf_dir, lambda c: parse_manchester(render_manchester(parse_dl(render_dl(c)))))


@query(_BIG_SQL, market=False)
def canonical_order(spark, sf_dir):
    """Operands put in the total order of expressions."""
    return _rewritten(spark, sf_dir, lambda c: E.And(tuple(sorted(c.of, key=algebra.sort_key, reverse=True))))


@query(f"SELECT * FROM (VALUES ('{_BIG}', 9), ('Customer', 1), ('∃ placed.Order', 3), ('≥ 2 placed.Order', 4), ('¬Customer', 2)) t(expression, n)", market=False)
def expression_lengths(spark, sf_dir):
    return spark.createDataFrame([(x, algebra.length(parse_dl(x))) for x in (_BIG, "Customer", "∃ placed.Order", "≥ 2 placed.Order", "¬Customer")], "expression string, n int")


def _compiled(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """The expression as SQL over views of a materialised graph."""
    g = materialise.materialise(star_triples(spark, sf_dir))
    tag = uuid.uuid4().hex
    views = {"universe": g.universe_frame(), "types": g.table("class_assertion"), "links": g.table("obj_assertion"), "vals": g.table("data_assertion")}
    return spark.sql(f"WITH {', '.join(f'{v} AS (SELECT * FROM {{{v}}})' for v in views)} {to_sql(parse_dl(expression))}", **views) if tag else None


@query("SELECT 'customer/' || o_custkey AS ind FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND count(*) FILTER (o_orderpriority = '1-URGENT') <= 2", market=False)
def compiled_to_sql(spark, sf_dir):
    return _compiled(spark, sf_dir, "(≥ 12 placed.⊤) ⊓ (≤ 2 placed.UrgentOrder)")


@query("SELECT 'customer/' || c_custkey AS ind FROM customer WHERE c_acctbal >= 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders)", market=False)
def compiled_data_to_sql(spark, sf_dir):
    return _compiled(spark, sf_dir, "(∃ acctbal.xsd:double[>= 5000]) ⊓ (∃ placed.⊤) ⊓ (∀ placed.¬UrgentOrder)")


@query("SELECT 'SELECT (COUNT(DISTINCT ?x) AS ?cnt) WHERE { VALUES ?x { <customer/' || c_custkey || '> } ?x a/<http://www.w3.org/2000/01/rdf-schema#subClassOf>* <Customer> . }' AS sparql FROM customer WHERE c_custkey = 5", market=False)
def compiled_to_sparql(spark, sf_dir):
    return spark.createDataFrame([(to_sparql(Class("Customer"), counted=True, among=["customer/5"]),)], "sparql string")


@query("SELECT 'Class' AS kind, 2::BIGINT AS n, 1.0::DOUBLE AS jaccard, 1.0::DOUBLE AS f1 UNION ALL SELECT 'Some', 1, round(a / b, 9), round(2 * a / (a + b), 9) FROM (SELECT count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS a, count(DISTINCT o_custkey) AS b FROM orders)", market=False)
def agreement_by_kind(spark, sf_dir):
    """Answers of mapped tables against those of triples, on average by kind of expression; the last pair differs on purpose."""
    a, b = Reasoner(star_graph(spark, sf_dir)), Reasoner(star_triples(spark, sf_dir))
    pairs = [("Customer", "Customer"), ("UrgentOrder", "UrgentOrder"), ("∃ placed.UrgentOrder", "∃ placed.⊤")]
    out = metrics.agreement_table(spark, [(type(parse_dl(x)).__name__, a.instances(parse_dl(x)), b.instances(parse_dl(y))) for x, y in pairs])
    return out.withColumns({"jaccard": F.round("jaccard", 9), "f1": F.round("f1", 9)})


# ---- embeddings: relation vectors of ones, so that a link's score is the logistic of a dot product

_VEC = "v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE id IN ('0', '1', '2')), hit AS (SELECT q.id AS known, v.id AS found, 1 / (1 + exp(-list_dot_product(v.e, q.e))) AS score FROM q, v)"


def _embedded(spark: SparkSession, sf_dir: str, gamma: float) -> EmbeddingGraph:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))
    ones = F.transform("vec", lambda x: F.lit(1.0).cast("float"))
    names = [TYPE, SUB, RDFS + "domain", RDFS + "range", RDFS + "subPropertyOf", "near"]
    relations = vectors.where("id = '0'").select(F.explode(F.array(*map(F.lit, names))).alias("id"), ones.alias("vec"))
    few = vectors.where("id in ('0', '1', '2')").select(F.col("id").alias("ind"))
    return EmbeddingGraph(vectors, relations, gamma, individuals=few)


@query(f"WITH {_VEC} SELECT known, found, round(score, 6) AS score FROM hit WHERE score >= 0.56", market=False)
def embedding_links(spark, sf_dir):
    """Links predicted for some heads."""
    return _embedded(spark, sf_dir, 0.56).predict(h=["0", "1", "2", "unknown"], r="near").select("known", "found", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT DISTINCT found AS ind FROM hit WHERE known = '0' AND score >= 0.6", market=False)
def embedding_class(spark, sf_dir):
    """Predicted instances of a class and of its predicted subclasses' own level."""
    return Reasoner(_embedded(spark, sf_dir, 0.6), subs=False).instances(Class("0"))


@query(f"WITH {_VEC} SELECT known AS ind FROM hit WHERE score >= 0.5 AND found IN ('0', '1', '2') GROUP BY known HAVING count(*) >= 2", market=False)
def embedding_min_card(spark, sf_dir):
    """Counts of predicted links among a stated set."""
    return Reasoner(_embedded(spark, sf_dir, 0.5)).instances(E.Card(">=", 2, Prop("near")))


@query(f"WITH {_VEC} SELECT id AS ind FROM q WHERE id NOT IN (SELECT known FROM hit WHERE score >= 0.51 AND found <> known AND found IN ('0', '1', '2'))", market=False)
def embedding_complement(spark, sf_dir):
    """Those linked to no other of a stated set."""
    r = Reasoner(_embedded(spark, sf_dir, 0.51))
    others = reduce(r.either, [r.both(r.sets(E.OneOf((i,))), r.sets(E.Some(Prop("near"), E.OneOf(tuple(sorted({"0", "1", "2"} - {i})))))) for i in ("0", "1", "2")])
    return r.named(r.minus(r.graph.universe(), others))


@query(f"WITH {_VEC} SELECT 'domain' AS what, found AS iri FROM hit WHERE known = '1' AND score >= 0.58 UNION ALL SELECT 'super', found FROM hit WHERE known = '1' AND score >= 0.58 AND found <> '1' UNION ALL SELECT 'sub', found FROM hit WHERE known = '1' AND score >= 0.58 AND found <> '1'", market=False)
def embedding_schema(spark, sf_dir):
    g = _embedded(spark, sf_dir, 0.58)
    return reduce(DataFrame.unionAll, [df.select(F.lit(what).alias("what"), "iri") for what, df in (("domain", g.domains("1")), ("super", g.super_classes("1")), ("sub", g.sub_classes("1")))])


# ---- edits

_N = NS + "new."


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (Class(_N + x) for x in "ABC")
    p, d = Prop(_N + "p"), Prop(_N + "d")
    axioms = [
        axiom("Declaration", "Class", a), axiom("ClassAssertion", a, _N + "x"), axiom("ObjectPropertyAssertion", p, _N + "x", _N + "y"), axiom("ObjectPropertyAssertion", p.flipped(), _N + "x", _N + "z"), axiom("DataPropertyAssertion", d, _N + "x", Literal("4", XSD + "integer")),
        axiom("NegativeObjectPropertyAssertion", p, _N + "y", _N + "x"), axiom("SubClassOf", a, E.And((b, c))), axiom("EquivalentClasses", a, b, c), axiom("DisjointUnion", Class(_N + "D"), a, b), axiom("SameIndividual", _N + "x", _N + "y"), axiom("DifferentIndividuals", _N + "x", _N + "y", _N + "z"),
        axiom("SubObjectPropertyOf", p, Prop(_N + "q")), axiom("ObjectPropertyDomain", p, a), axiom("DataPropertyRange", d, E.Datatype(XSD + "integer")), axiom("InverseObjectProperties", p, Prop(_N + "r")), axiom("TransitiveObjectProperty", p), axiom("FunctionalDataProperty", d),
    ]
    g, out = mutate.add(market_graph(spark, sf_dir), axioms), []
    for table, first, second in (("class_assertion", "cls", "ind"), ("obj_assertion", "s", "o"), ("data_assertion", "s", "lex"), ("neg_obj_assertion", "s", "o"), ("sub_class", "sub", "sup"), ("equivalent_class", "a", "b"), ("disjoint_class", "a", "b"), ("same_as", "a", "b"), ("different_from", "a", "b"), ("sub_prop", "sub", "sup"), ("domain", "p", "cls"), ("range", "p", "cls"), ("inverse_prop", "p", "q"), ("characteristic", "p", "name")):
        out.append(g.table(table).select(F.lit(table).alias("tab"), F.col(first).alias("x"), F.col(second).alias("y")))
    return reduce(DataFrame.unionAll, out)


_NEW = ", ".join(f"('{t}', '{_N}{x}', {y})" for t, x, y in (
    *((t, x, f"'{_N}{y}'") for t, x, y in (("class_assertion", "A", "x"), ("obj_assertion", "x", "y"), ("obj_assertion", "z", "x"), ("neg_obj_assertion", "y", "x"), ("sub_class", "A", "B"), ("sub_class", "A", "C"), ("sub_class", "A", "D"), ("sub_class", "B", "D"), ("equivalent_class", "A", "B"), ("equivalent_class", "A", "C"), ("equivalent_class", "B", "C"), ("disjoint_class", "A", "B"), ("same_as", "x", "y"), ("different_from", "x", "y"), ("different_from", "x", "z"), ("different_from", "y", "z"), ("sub_prop", "p", "q"), ("domain", "p", "A"), ("inverse_prop", "p", "r"))),
    ("data_assertion", "x", "'4'"), ("range", "d", f"'{XSD}integer'"), ("characteristic", "p", "'TransitiveProperty'"), ("characteristic", "d", "'FunctionalProperty'"),
))
_OLD = f"""SELECT 'class_assertion' AS tab, cls AS x, ind AS y FROM class_assertion UNION ALL SELECT 'obj_assertion', s, o FROM links UNION ALL SELECT 'data_assertion', s, lex FROM data_assertion UNION ALL SELECT 'sub_class', sub, sup FROM sub_class
UNION ALL SELECT 'equivalent_class', a, b FROM equivalent_class UNION ALL SELECT 'disjoint_class', a, b FROM disjoint_class UNION ALL SELECT 'same_as', a, b FROM same_as UNION ALL SELECT 'different_from', a, b FROM different_from UNION ALL SELECT 'sub_prop', sub, sup FROM sub_prop
UNION ALL SELECT 'domain', '{BUYS}', '{PLACE}' UNION ALL SELECT 'range', '{BUYS}', '{DOCUMENT}' UNION ALL SELECT 'inverse_prop', '{BUYS}', '{BOUGHT_BY}' UNION ALL SELECT 'characteristic', '{BUYS}', 'AsymmetricProperty'"""


@query(f"{_OLD} UNION ALL SELECT * FROM (VALUES {_NEW}) t(tab, x, y)")
def added_axioms(spark, sf_dir):
    """Axioms of seventeen kinds added to a graph; every table as it is then."""
    return _edited(spark, sf_dir)


@query(f"SELECT 'class_assertion' AS tab, cls AS x, ind AS y FROM class_assertion WHERE ind <> '{NS}customer.3' UNION ALL SELECT 'obj_assertion', s, o FROM links WHERE s <> '{NS}customer.3' UNION ALL SELECT 'same_as', a, b FROM same_as WHERE a <> '{NS}customer.3'")
def removed_declaration(spark, sf_dir):
    """An individual's declaration removed, and all that was said of it."""
    g = mutate.remove(market_graph(spark, sf_dir), [axiom("Declaration", "NamedIndividual", f"{NS}customer.3")])
    return reduce(DataFrame.unionAll, [g.table(t).select(F.lit(t).alias("tab"), F.col(x).alias("x"), F.col(y).alias("y")) for t, x, y in (("class_assertion", "cls", "ind"), ("obj_assertion", "s", "o"), ("same_as", "a", "b"))])


@query("SELECT x.b AS a, y.b FROM (SELECT DISTINCT p_type AS t, p_brand AS b FROM part) x JOIN (SELECT DISTINCT p_type AS t, p_brand AS b FROM part) y ON x.t = y.t AND x.b < y.b", market=False)
def pairwise_axioms(spark, sf_dir):
    """Statements on groups of names as statements on pairs."""
    groups = _table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("members"))
    return mutate.pairwise(groups)


# ---- scalars


@query(
    f"""SELECT DISTINCT p_name, lower(regexp_replace(trim(regexp_replace(p_name, '[^\\w\\s]', '', 'g')), '\\s+', '_', 'g')) AS snake, regexp_extract(p_brand, '([^/:#]*)$', 1) AS short, '{XSD}integer' AS size_type, '{XSD}double' AS price_type, '{XSD}string' AS name_type FROM part""",
    market=False,
)
def name_functions(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    guess = lambda c: T.guessed_datatype(F.col(c).cast("string"))
    return part.select("p_name", T.snake_case(F.col("p_name")).alias("snake"), T.short_form(F.col("p_brand")).alias("short"), guess("p_size").alias("size_type"), guess("p_retailprice").alias("price_type"), guess("p_name").alias("name_type")).distinct()


@query("SELECT nation AS ind, n_name AS label FROM nat UNION SELECT region, regexp_extract(region, '([^/:#]*)$', 1) FROM nat")
def labels_of(spark, sf_dir):
    """Labels where a name has one, short forms elsewhere."""
    g = market_graph(spark, sf_dir)
    names = g.table("sub_class").where(F.col("sup").startswith(f"{NS}region.")).select(F.explode(F.array("sub", "sup")).alias("ind")).distinct()
    return T.labelled(names, g.table("annotation"))


_SPELT = ("color", "Center", "gray", "plow", "modeling", "house")


@query("SELECT * FROM (VALUES ('color', 'colour'), ('Center', 'centre'), ('gray', 'grey'), ('plow', 'plough'), ('modeling', 'modelling'), ('house', 'house')) t(word, british)", market=False)
def british_spelling(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in _SPELT], "word string").select("word", T.british(F.col("word")).alias("british"))


@query("SELECT p_partkey, try_cast(p_brand AS BIGINT) AS brand, try_cast(p_size::VARCHAR AS BIGINT) AS size, try_cast(p_retailprice::VARCHAR AS DOUBLE) AS price FROM part", market=False)
def typed_texts(spark, sf_dir):
    """Texts cast where they can be, else null."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"))
    return part.select("p_partkey", *[F.col(c).try_cast(t).alias(c) for c, t in (("brand", "bigint"), ("size", "bigint"), ("price", "double"))])

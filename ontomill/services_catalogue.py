"""Registered queries for everything beside class expressions: navigation, materialisation, metrics, sources, texts, embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.functions import text as T
from ontomill.operators import extract, materialise, metrics, mutate, perturb
from ontomill.operators.embedding import similar
from ontomill.operators.retrieval import Reasoner
from ontomill.operators.rules import RuleEngine, parse_rule
from ontomill.operators.schema import Hierarchy, Schema
from ontomill.plans.expr import Prop, axiom
from ontomill.plans.graph import connected_components, transitive_closure
from ontomill.plans.syntax import parse_dl, parse_manchester
from ontomill.sources import rdf, tabular
from ontomill.sources.graphs import ASSERTIONS, TABLES
from ontomill.sources.star import star_graph
from ontomill.sources.star_triples import DOMAINS, SUB_CLASSES, star_triples
from ontomill.streaming.ingest import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in SUB_CLASSES)
_CLOSURE = f"WITH RECURSIVE e(sub, sup) AS (VALUES {_PAIRS}), c AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM c JOIN e ON c.sup = e.sub)"
_DOCS = "SELECT 'doc/' || doc_id AS ind"


def query(sql: str = "") -> Callable:
    """Registers a function under its name, with its SQL if there is any."""
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUB_CLASSES, "sub string, sup string")


@query("SELECT 'customer/' || c_custkey AS ind FROM customer WHERE c_acctbal < 0 UNION SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal < 0")
def class_with_subclasses(spark, sf_dir):
    """Agents with a negative balance, over two steps of subclasses, in the triple graph."""
    return Reasoner(star_triples(spark, sf_dir)).instances(parse_dl("Agent ⊓ ∃ acctbal.xsd:double[< 0.0]"))


@query("SELECT 'order/' || o_orderkey AS ind FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment <> 'BUILDING'")
def triples_restriction(spark, sf_dir):
    """Urgent orders whose customers all are outside the building segment, in Manchester syntax."""
    return Reasoner(star_triples(spark, sf_dir)).instances(parse_manchester("UrgentOrder and placedBy only (not BuildingCustomer)"))


@query("SELECT 'customer/' || o_custkey AS ind FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def triples_min_card(spark, sf_dir):
    """Customers of many orders, over a declared inverse."""
    return Reasoner(star_triples(spark, sf_dir)).instances(parse_dl("≥ 12 placed.⊤"))


@query(f"{_CLOSURE} SELECT DISTINCT sub, sup FROM c")
def closure(spark, sf_dir):
    return transitive_closure(_edges(spark), "sub", "sup")


@query(f"{_CLOSURE} SELECT DISTINCT sub, sup FROM c WHERE NOT EXISTS (SELECT 1 FROM c a JOIN c b ON a.sup = b.sub WHERE a.sub = c.sub AND b.sup = c.sup)")
def hierarchy_covers(spark, sf_dir):
    return Hierarchy(_edges(spark)).covers()


@query(f"{_CLOSURE} SELECT DISTINCT sub AS item FROM c WHERE sup = 'Agent'")
def sub_classes(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).sub_classes("Agent").where(F.col("item") != "Agent")


@query(f"{_CLOSURE} SELECT DISTINCT sup AS item FROM c WHERE sub = 'BuildingCustomer'")
def super_classes(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).super_classes("BuildingCustomer")


@query("SELECT * FROM (VALUES ('Nation'), ('Place'), ('Region')) t(iri)")
def disjoint_classes(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).disjoint_classes("BuildingCustomer")


@query(f"SELECT cls AS iri FROM (VALUES {', '.join(str(d) for d in DOMAINS)}) t(p, cls) WHERE p = 'within'")
def domains(spark, sf_dir):
    """Domains of a property, over the property above it."""
    return Schema(star_triples(spark, sf_dir)).domains("basedIn")


@query("SELECT * FROM (VALUES ('inNation'), ('basedIn'), ('inRegion')) t(item)")
def sub_properties(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).sub_properties("within")


@query("SELECT unnest(['Customer', 'Party', 'Agent']) AS iri UNION ALL SELECT 'BuildingCustomer' FROM customer WHERE c_custkey = 1 AND c_mktsegment = 'BUILDING'")
def types_of(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).types("customer/1")


@query("SELECT 'order/' || o_orderkey AS o FROM orders WHERE o_custkey = 1")
def object_property_values(spark, sf_dir):
    return Reasoner(star_graph(spark, sf_dir)).object_property_values("customer/1", Prop("placedBy", True))


@query("SELECT 'part/' || p_partkey AS s, p_size::VARCHAR AS lex, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM part")
def data_property_values(spark, sf_dir):
    return Reasoner(star_graph(spark, sf_dir)).data_property_values("size")


@query("SELECT * FROM (VALUES ('acctbal')) t(p)")
def properties_of_individual(spark, sf_dir):
    return Schema(star_triples(spark, sf_dir)).properties_of("supplier/1", "data")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def count_query(spark, sf_dir):
    return Reasoner(star_graph(spark, sf_dir)).count(parse_dl("Customer ⊓ ∃ placed.(∃ totalprice.xsd:double[> 300000.0])"))


@query("SELECT 'customer/' || c_custkey AS ind FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5")
def values_query(spark, sf_dir):
    """Instances among given examples."""
    examples = _table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.concat(F.lit("customer/"), "c_custkey").alias("ind"))
    return Reasoner(star_graph(spark, sf_dir)).among(parse_dl("BuildingCustomer"), examples)


@query("SELECT count(*) FILTER (q = 1 AND hit) AS tp, count(*) FILTER (q = 1 AND NOT hit) AS fn, count(*) FILTER (q = 0 AND hit) AS fp, count(*) FILTER (q = 0 AND NOT hit) AS tn FROM (SELECT quality AS q, n_chars > 1000 AND lang = 'en' AS hit FROM labels JOIN documents USING (doc_id))")
def confusion_matrix(spark, sf_dir):
    """Long English documents as a guess at quality."""
    y = _table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), "doc_id").alias("ind"), "quality")
    found = Reasoner(star_graph(spark, sf_dir)).instances(parse_dl("EnglishDocument ⊓ ∃ n_chars.xsd:integer[> 1000]"))
    return metrics.confusion_matrix(found, y.where("quality = 1"), y.where("quality = 0"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM documents WHERE n_chars > 1000), n AS (SELECT (SELECT count(*) FROM a JOIN b USING (doc_id)) AS hits, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT hits AS \"both\", na - hits AS only_predicted, nb - hits AS only_wanted, round(hits / (na + nb - hits), 9) AS jaccard, round(2 * hits / (na + nb), 9) AS f1 FROM n")
def jaccard_f1(spark, sf_dir):
    r = Reasoner(star_graph(spark, sf_dir))
    out = metrics.agreement(r.instances(parse_dl("EnglishDocument")), r.instances(parse_dl("∃ n_chars.xsd:integer[> 1000]")))
    return out.withColumns({"jaccard": F.round("jaccard", 9), "f1": F.round("f1", 9)})


@query("SELECT 'nation/' || n_nationkey AS s, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS p, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS lex FROM nation")
def rows_to_triples(spark, sf_dir):
    """A table's rows as individuals, its columns as data properties."""
    return tabular.rows_to_graph(_table(spark, sf_dir, "nation"), "nation/", key="n_nationkey").table("data_assertion").select("s", F.expr("substring(p, 8)").alias("p"), "lex")


@query("SELECT 'nation/' || n_nationkey AS ind, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def triples_to_rows(spark, sf_dir):
    g = tabular.rows_to_graph(_table(spark, sf_dir, "nation"), "nation/", key="n_nationkey")
    return tabular.graph_to_rows(g, ["n_name", "n_regionkey"])


@query("SELECT count(*)::BIGINT AS n FROM (SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM region UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM orders UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT') x")
def triple_count(spark, sf_dir):
    """Triples of the assertions."""
    g = star_triples(spark, sf_dir)
    return rdf.triples_of(g.replaced(**{k: g.table(k).limit(0) for k in TABLES if k not in ASSERTIONS})).agg(F.count("*").alias("n"))


@query("WITH types AS (SELECT 'order/' || o_orderkey AS ind, unnest(['Order', 'Document']) AS cls FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'UrgentOrder' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'customer/' || c_custkey, unnest(['Customer', 'Party', 'Agent', 'Located']) FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'BuildingCustomer' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'supplier/' || s_suppkey, unnest(['Supplier', 'Party', 'Agent', 'Located']) FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, unnest(['Nation', 'Place', 'Located']) FROM nation UNION ALL SELECT 'region/' || r_regionkey, unnest(['Region', 'Place']) FROM region) SELECT ind, cls FROM types")
def materialised_types(spark, sf_dir):
    """All types that follow: subclasses, domains, ranges."""
    return materialise.materialise(star_triples(spark, sf_dir)).table("class_assertion").select("ind", "cls")


@query("SELECT 'customer/' || c_custkey AS s, unnest(['nation/' || c_nationkey, 'region/' || n_regionkey]) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier/' || s_suppkey, unnest(['nation/' || s_nationkey, 'region/' || n_regionkey]) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation")
def materialised_transitive(spark, sf_dir):
    """A transitive property above three others."""
    return materialise.materialise(star_triples(spark, sf_dir)).table("obj_assertion").where("p = 'within'").select("s", "o")


@query("SELECT 'order/' || o_orderkey AS s, 'nation/' || c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def property_chain(spark, sf_dir):
    return materialise.materialise(star_triples(spark, sf_dir)).table("obj_assertion").where("p = 'fromNation'").select("s", "o")


@query("SELECT NULL::VARCHAR AS rule, NULL::VARCHAR AS subject WHERE false")
def inconsistencies(spark, sf_dir):
    return materialise.inconsistencies(materialise.materialise(star_triples(spark, sf_dir)))


@query(f"{_CLOSURE} SELECT 'InferredSubClassAxiomGenerator' AS kind, sub AS a, sup AS b FROM (SELECT DISTINCT sub, sup FROM c EXCEPT SELECT sub, sup FROM e) x")
def inferred_axioms(spark, sf_dir):
    return materialise.inferred(star_triples(spark, sf_dir), ("InferredSubClassAxiomGenerator",))


@query("SELECT 'order/' || o_orderkey AS s, 'region/' || n_regionkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 9000")
def rule_query(spark, sf_dir):
    """A Horn rule with a built-in."""
    rule = parse_rule("UrgentOrder(?x) ^ placedBy(?x, ?c) ^ acctbal(?c, ?b) ^ swrlb:greaterThan(?b, 9000) ^ inNation(?c, ?n) ^ inRegion(?n, ?r) -> to(?x, ?r)")
    return RuleEngine(star_triples(spark, sf_dir)).heads(rule)[1][0].select("s", "o").distinct()


@query("SELECT 'customer/' || c_custkey AS ind FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey <> 3 UNION SELECT 'customer/2'")
def mutated(spark, sf_dir):
    """One assertion added, one removed."""
    g = mutate.add(star_triples(spark, sf_dir), [axiom("ClassAssertion", parse_dl("BuildingCustomer"), "customer/2")])
    g = mutate.remove(g, [axiom("ClassAssertion", parse_dl("BuildingCustomer"), "customer/3")])
    return Reasoner(g, subs=False).instances(parse_dl("BuildingCustomer"))


@query("SELECT 3 * (SELECT count(*) FROM customer) + 3 * (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') + (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total")
def assertion_total(spark, sf_dir):
    g = star_triples(spark, sf_dir)
    frames = [g.table(n).agg(F.count("*").alias("n")) for n in ("class_assertion", "obj_assertion", "data_assertion")]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).agg(F.sum("n").alias("total"))


#: The assertions of the graph as rows (t, x, y, z, w), and the hash by which ``perturb`` picks.
_ASSERTED = """WITH a AS (SELECT 'c' AS t, 'Region' AS x, 'region/' || r_regionkey AS y, NULL::VARCHAR AS z, NULL::VARCHAR AS w FROM region UNION ALL SELECT 'c', 'Nation', 'nation/' || n_nationkey, NULL, NULL FROM nation
UNION ALL SELECT 'c', 'Customer', 'customer/' || c_custkey, NULL, NULL FROM customer UNION ALL SELECT 'c', 'Supplier', 'supplier/' || s_suppkey, NULL, NULL FROM supplier
UNION ALL SELECT 'c', 'BuildingCustomer', 'customer/' || c_custkey, NULL, NULL FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'c', 'UrgentOrder', 'order/' || o_orderkey, NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'o', 'inRegion', 'nation/' || n_nationkey, 'region/' || n_regionkey, NULL FROM nation UNION ALL SELECT 'o', 'inNation', 'customer/' || c_custkey, 'nation/' || c_nationkey, NULL FROM customer
UNION ALL SELECT 'o', 'basedIn', 'supplier/' || s_suppkey, 'nation/' || s_nationkey, NULL FROM supplier UNION ALL SELECT 'o', 'placedBy', 'order/' || o_orderkey, 'customer/' || o_custkey, NULL FROM orders
UNION ALL SELECT 'd', 'acctbal', 'customer/' || c_custkey, c_acctbal::VARCHAR, 'http://www.w3.org/2001/XMLSchema#double' FROM customer UNION ALL SELECT 'd', 'acctbal', 'supplier/' || s_suppkey, s_acctbal::VARCHAR, 'http://www.w3.org/2001/XMLSchema#double' FROM supplier
UNION ALL SELECT 'd', 'label', 'nation/' || n_nationkey, n_name, 'http://www.w3.org/2001/XMLSchema#string' FROM nation), inds AS (SELECT y AS ind FROM a UNION SELECT z FROM a WHERE t = 'o')"""


def _hash(seed: int, *columns: str) -> str:
    told = " || ',' || ".join(f"""coalesce('"=' || {c} || '"', '"-"')""" for c in columns)
    return f"""('0x' || substr(md5('["{seed}",' || {told} || ']'), 1, 15))::BIGINT"""


@query(f"{_ASSERTED}, gone AS (SELECT * FROM a QUALIFY row_number() OVER (ORDER BY {_hash(7, *'txyzw')}) <= (SELECT floor(count(*) * 20 / 100) FROM a)) SELECT x AS p, y AS s, z AS o FROM a WHERE t = 'o' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.t = 'o' AND g.x = a.x AND g.y = a.y AND g.z = a.z)")
def incomplete_assertions(spark, sf_dir):
    """The links that are left when a share of all assertions is dropped by hash."""
    return perturb.without_assertions(star_triples(spark, sf_dir), 20, 7).table("obj_assertion")


@query(f"{_ASSERTED} SELECT x AS cls, y AS ind FROM a WHERE t = 'c' AND y NOT IN (SELECT ind FROM inds QUALIFY row_number() OVER (ORDER BY {_hash(7, 'ind')}) <= (SELECT floor(count(*) * 10 / 100) FROM inds))")
def incomplete_individuals(spark, sf_dir):
    return perturb.without_individuals(star_triples(spark, sf_dir), 10, 7).table("class_assertion")


@query(
    f"""{_ASSERTED}, k AS (SELECT DISTINCT x AS cls FROM a WHERE t = 'c'), numbered AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS no FROM k),
    drawn AS (SELECT cls, ind FROM inds JOIN numbered ON no = {_hash(8, 'ind')} % (SELECT count(*) FROM k)), wrong AS (SELECT cls, ind FROM drawn WHERE NOT EXISTS (SELECT 1 FROM a WHERE t = 'c' AND x = cls AND y = ind)),
    total AS (SELECT floor((SELECT count(*) FROM a) * 5 / 100)::BIGINT AS n), made AS (SELECT cls, ind FROM wrong QUALIFY row_number() OVER (ORDER BY {_hash(7, 'cls', 'ind')}) <= (SELECT n // 2 FROM total)),
    turned AS (SELECT x AS p, z AS s, y AS o FROM a WHERE t = 'o' QUALIFY row_number() OVER (ORDER BY {_hash(7, 'x', 'z', 'y')}) <= (SELECT n - n // 2 FROM total))
    SELECT x AS p, y AS s, NULL AS o FROM a WHERE t = 'c' UNION ALL SELECT cls, ind, NULL FROM made UNION ALL SELECT x, y, z FROM a WHERE t = 'o' UNION ALL SELECT p, s, o FROM turned"""
)
def inconsistent_graph(spark, sf_dir):
    """Class assertions and links of a graph to which wrong ones were added, five for each hundred assertions."""
    g = perturb.with_wrong_assertions(star_triples(spark, sf_dir), 5, 7)
    return g.table("class_assertion").select(F.col("cls").alias("p"), F.col("ind").alias("s"), F.lit(None).cast("string").alias("o")).unionAll(g.table("obj_assertion").select("p", "s", "o"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) >= 0.3")
def embedding_threshold(spark, sf_dir):
    """Vectors near a given one."""
    vectors = _table(spark, sf_dir, "embeddings")
    q = list(vectors.where("vec_id = 0").first().embedding)
    return similar(vectors, q, 0.3).select("id", F.round("score", 6).alias("score"))


@query()
def chunks_fixed(spark, sf_dir):
    return T.chunked(_table(spark, sf_dir, "documents"), 1000, 100, "fixed")


@query()
def chunks_sentence(spark, sf_dir):
    return T.chunked(_table(spark, sf_dir, "documents"), 1000, 100, "sentence")


@query()
def chunks_paragraph(spark, sf_dir):
    return T.chunked(_table(spark, sf_dir, "documents"), 1000, 100, "paragraph")


@query(r"SELECT id, (i - 1)::INTEGER AS sentence_no, parts[i] AS sentence FROM (SELECT doc_id AS id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents) t) u")
def sentences(spark, sf_dir):
    return T.sentences(_table(spark, sf_dir, "documents"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS n FROM documents")
def estimated_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query()
def html_text_parsed(spark, sf_dir):
    return tabular.html_texts(_table(spark, sf_dir, "pages"))


@query()
def extracted_statements(spark, sf_dir):
    return extract.statements(_table(spark, sf_dir, "documents"))


@query("SELECT arg_max(w, (n, w)) AS entity, sum(n)::BIGINT AS n FROM (SELECT w, count(*) AS n FROM (SELECT p_name AS w FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT p_brand FROM part) x GROUP BY w) y GROUP BY lower(w)")
def merged_entities(spark, sf_dir):
    """Names merged but for case, the spelling that occurs most."""
    part = _table(spark, sf_dir, "part")
    found = part.select(F.col("p_name").alias("subject"), F.col("p_type").alias("object")).unionAll(part.select(F.upper("p_brand"), "p_brand"))
    return extract.entities(found)


@query("SELECT arg_min(p_brand, p_partkey) AS s, arg_min(p_type, p_partkey) AS o FROM part GROUP BY lower(p_brand), lower(p_type)")
def merged_triples(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("s"), F.col("p_type").alias("o"), "p_partkey")
    return extract.merged(part, ["s", "o"], ["p_partkey"])


@query("SELECT DISTINCT url, regexp_extract(url, '([^/:#]*)$', 1) AS remainder, regexp_extract(url, '^(.*[/:#])[^/:#]*$', 1) AS namespace FROM pages")
def iri_parts(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("url", T.remainder(u).alias("remainder"), T.namespace(u).alias("namespace")).distinct()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """The table form of the streaming aggregate."""
    return counts(_table(spark, sf_dir, "events"), "ts", "event_type")


@query(
    """SELECT DISTINCT kind || '/' || k AS node, 'customer/' || min(c) OVER (PARTITION BY n) AS root FROM (SELECT 'customer' AS kind, c_custkey AS k, c_custkey AS c, c_nationkey AS n FROM customer
    UNION ALL SELECT 'order', o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'nation', c_nationkey, c_custkey, c_nationkey FROM customer) x"""
)
def connected(spark, sf_dir):
    """Orders linked to their customers and customers to their nations: a component for each nation, by its least customer's key."""
    name = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    customer, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    edges = customer.select(name("customer", "c_custkey").alias("a"), name("nation", "c_nationkey").alias("b"))
    parts = connected_components(edges.unionAll(orders.select(name("order", "o_orderkey"), name("customer", "o_custkey"))), "a", "b")
    key = F.when(F.col("node").startswith("customer/"), F.expr("bigint(substring(node, 10))"))
    least = parts.groupBy("root").agg(F.concat(F.lit("customer/"), F.min(key).cast("string")).alias("least"))
    return parts.join(least, "root").select("node", F.col("least").alias("root"))


@query(f"{_DOCS}, n_chars AS score FROM documents ORDER BY n_chars DESC, ind LIMIT 10")
def best_list(spark, sf_dir):
    """A bounded list of the best by score."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("ind"), F.col("n_chars").alias("score"))
    return metrics.best(docs, 10)

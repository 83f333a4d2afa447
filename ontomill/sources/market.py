"""The star schema's tables as a triple graph whose hierarchies, equivalences and constraints come from the data too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.plans.expr import OWL, RDFS, XSD
from ontomill.sources.graphs import TABLES, TripleGraph

NS = "urn:m:"
PLACE, PRODUCT, DOCUMENT, BUYS, ORDERED, BOUGHT_BY, BALANCE = (NS + x for x in ("Place", "Product", "Document", "buys", "ordered", "boughtBy", "balance"))

#: The same tables as SQL views, to put before a query: ``WITH RECURSIVE`` and these.
SQL = f"""
nat AS (SELECT n_nationkey AS k, '{NS}nation.' || replace(n_name, ' ', '_') AS nation, '{NS}region.' || replace(r_name, ' ', '_') AS region, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
kinds AS (SELECT DISTINCT '{NS}brand.' || replace(p_brand, '#', '.') AS brand, '{NS}type.' || replace(p_type, ' ', '_') AS type FROM part),
sub_class AS (SELECT nation AS sub, region AS sup FROM nat UNION SELECT region, '{PLACE}' FROM nat UNION SELECT brand, type FROM kinds UNION SELECT type, '{PRODUCT}' FROM kinds),
equivalent_class AS (SELECT nation AS a, '{NS}code.' || k AS b FROM nat),
regions AS (SELECT DISTINCT region FROM nat),
disjoint_class AS (SELECT a.region AS a, b.region AS b FROM regions a JOIN regions b ON a.region < b.region UNION ALL SELECT '{PLACE}', '{PRODUCT}'),
different_from AS (SELECT a.region AS a, b.region AS b FROM regions a JOIN regions b ON a.region < b.region),
links AS (SELECT '{BUYS}_' || replace(o_orderpriority, ' ', '_') AS p, '{NS}customer.' || o_custkey AS s, '{NS}order.' || o_orderkey AS o FROM orders),
sub_prop AS (SELECT DISTINCT p AS sub, '{BUYS}' AS sup FROM links),
class_assertion AS (SELECT nation AS cls, '{NS}customer.' || c_custkey AS ind FROM customer JOIN nat ON c_nationkey = k UNION ALL SELECT '{NS}brand.' || replace(p_brand, '#', '.'), '{NS}part.' || p_partkey FROM part),
data_assertion AS (SELECT '{BALANCE}' AS p, '{NS}customer.' || c_custkey AS s, c_name AS lex, '{XSD}string' AS dt FROM customer),
same_as AS (SELECT '{NS}customer.' || c_custkey AS a, '{NS}supplier.' || s_suppkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey),
annotation AS (SELECT nation AS s, '{RDFS}label' AS p, n_name AS value FROM nat),
edges AS (SELECT sub, sup FROM sub_class UNION SELECT a, b FROM equivalent_class UNION SELECT b, a FROM equivalent_class),
above AS (SELECT sub, sup FROM edges UNION SELECT above.sub, edges.sup FROM above JOIN edges ON above.sup = edges.sub)
"""


def market_graph(spark: SparkSession, sf_dir: str) -> TripleGraph:
    """Nations below regions, brands below types, one sub-property of ``buys`` for each priority, customers that are suppliers."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    name = lambda kind, c: F.concat(F.lit(f"{NS}{kind}."), F.replace(F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("_")), F.lit("#"), F.lit(".")))
    nat = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", name("nation", "n_name").alias("nation"), name("region", "r_name").alias("region"))
    kinds = t["part"].select(name("brand", "p_brand").alias("brand"), name("type", "p_type").alias("type")).distinct()
    regions = nat.select("region").distinct()
    pairs = regions.select(F.col("region").alias("a")).join(regions.select(F.col("region").alias("b")), F.col("a") < F.col("b"))

    def rows(table: str, *frames: tuple[DataFrame, list[Column]]) -> DataFrame:
        names = [c.split()[0] for c in TABLES[table].split(", ")]
        return reduce(DataFrame.unionAll, [df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]) for df, columns in frames])

    c, place, product, buys = F.col, F.lit(PLACE), F.lit(PRODUCT), F.lit(BUYS)
    links = t["orders"].select(F.concat(F.lit(BUYS + "_"), F.replace(c("o_orderpriority"), F.lit(" "), F.lit("_"))).alias("p"), name("customer", "o_custkey").alias("s"), name("order", "o_orderkey").alias("o"))
    known = t["customer"].join(nat, c("c_nationkey") == c("n_nationkey"))
    tables = {
        "sub_class": rows("sub_class", (nat, [c("nation"), c("region")]), (regions, [c("region"), place]), (kinds, [c("brand"), c("type")]), (kinds.select("type").distinct(), [c("type"), product])),
        "equivalent_class": rows("equivalent_class", (nat, [c("nation"), name("code", "n_nationkey")])),
        "disjoint_class": rows("disjoint_class", (pairs, [c("a"), c("b")]), (spark.range(1), [place, product])),
        "different_from": rows("different_from", (pairs, [c("a"), c("b")])),
        "obj_assertion": links,
        "sub_prop": rows("sub_prop", (links.select("p").distinct(), [c("p"), buys])),
        "class_assertion": rows("class_assertion", (known, [c("nation"), name("customer", "c_custkey")]), (t["part"], [name("brand", "p_brand"), name("part", "p_partkey")])),
        "data_assertion": rows("data_assertion", (t["customer"], [F.lit(BALANCE), name("customer", "c_custkey"), c("c_name"), F.lit(XSD + "string")])),
        "same_as": rows("same_as", (t["customer"].join(t["supplier"], c("c_custkey") == c("s_suppkey")), [name("customer", "c_custkey"), name("supplier", "s_suppkey")])),
        "annotation": rows("annotation", (nat, [c("nation"), F.lit(RDFS + "label"), c("n_name")])),
        "equivalent_prop": spark.createDataFrame([(BUYS, ORDERED)], TABLES["equivalent_prop"]),
        "disjoint_prop": spark.createDataFrame([(BUYS + "_1-URGENT", BUYS + "_5-LOW")], TABLES["disjoint_prop"]),
        "inverse_prop": spark.createDataFrame([(BUYS, BOUGHT_BY)], TABLES["inverse_prop"]),
        "domain": spark.createDataFrame([(BUYS, PLACE)], TABLES["domain"]),
        "range": spark.createDataFrame([(BUYS, DOCUMENT)], TABLES["range"]),
        "characteristic": spark.createDataFrame([(BUYS, "AsymmetricProperty")], TABLES["characteristic"]),
    }
    return TripleGraph(spark, tables)


__all__ = ["NS", "OWL", "SQL", "market_graph"]

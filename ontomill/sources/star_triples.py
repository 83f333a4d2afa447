"""The dimension tables of the star schema and its orders as a triple graph, built by projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.plans.expr import XSD
from ontomill.sources.graphs import TABLES, TripleGraph

#: Edges of the class and property hierarchies, domains, ranges, disjoint classes, characteristics, chains, inverses.
SUB_CLASSES = [("BuildingCustomer", "Customer"), ("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Nation", "Place"), ("Region", "Place"), ("UrgentOrder", "Order"), ("Order", "Document")]
SUB_PROPERTIES = [("inNation", "within"), ("basedIn", "within"), ("inRegion", "within")]
DOMAINS, RANGES = [("placedBy", "Order"), ("within", "Located")], [("placedBy", "Customer"), ("inRegion", "Region")]
DISJOINT = [("Party", "Place")]
CHAIN = [("fromNation", ["placedBy", "inNation"])]


def star_triples(spark: SparkSession, sf_dir: str) -> TripleGraph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "orders")}
    name = lambda kind, column: F.concat(F.lit(kind + "/"), F.col(column).cast("string"))

    def types(cls: str, df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(cls).alias("cls"), name(kind, key).alias("ind"))

    def links(p: str, df: DataFrame, s: tuple[str, str], o: tuple[str, str]) -> DataFrame:
        return df.select(F.lit(p).alias("p"), name(*s).alias("s"), name(*o).alias("o"))

    def values(p: str, df: DataFrame, s: tuple[str, str], column: str, datatype: str) -> DataFrame:
        return df.select(F.lit(p).alias("p"), name(*s).alias("s"), F.col(column).cast("string").alias("lex"), F.lit(XSD + datatype).alias("dt"))

    keys = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "orders": ("order", "o_orderkey")}
    class_assertion = [types(c, t[n], *keys[n]) for c, n in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"))]
    class_assertion.append(types("BuildingCustomer", t["customer"].where("c_mktsegment = 'BUILDING'"), *keys["customer"]))
    class_assertion.append(types("UrgentOrder", t["orders"].where("o_orderpriority = '1-URGENT'"), *keys["orders"]))
    obj = [links("inRegion", t["nation"], keys["nation"], ("region", "n_regionkey")), links("inNation", t["customer"], keys["customer"], ("nation", "c_nationkey")), links("basedIn", t["supplier"], keys["supplier"], ("nation", "s_nationkey")), links("placedBy", t["orders"], keys["orders"], ("customer", "o_custkey"))]
    data = [values("acctbal", t["customer"], keys["customer"], "c_acctbal", "double"), values("acctbal", t["supplier"], keys["supplier"], "s_acctbal", "double"), values("label", t["nation"], keys["nation"], "n_name", "string")]
    small = {"sub_class": SUB_CLASSES, "sub_prop": SUB_PROPERTIES, "domain": DOMAINS, "range": RANGES, "disjoint_class": DISJOINT, "prop_chain": CHAIN, "inverse_prop": [("placedBy", "placed")], "characteristic": [("within", "TransitiveProperty")]}
    tables = {k: spark.createDataFrame(rows, TABLES[k]) for k, rows in small.items()}
    union = lambda frames: reduce(DataFrame.unionAll, frames)
    return TripleGraph(spark, tables | {"class_assertion": union(class_assertion), "obj_assertion": union(obj), "data_assertion": union(data)})

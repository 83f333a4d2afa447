"""The star schema and text tables as an ontology, mapped in place."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.plans.expr import XSD
from ontomill.sources.graphs import MappedGraph

#: Class, kind, table and key column of the tables whose rows are individuals.
KINDS = (
    ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"),
    ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Page", "pages", "page_id"), ("BenchmarkItem", "benchmark", "item_id"), ("Vector", "embeddings", "vec_id"),
)
#: Names of the individuals' kinds where they differ from the table's.
KIND_NAMES = {"orders": "order", "events": "event", "documents": "doc", "pages": "page", "embeddings": "vector"}
#: Subclasses that a column's value picks: parent, column, value and class.
SUBCLASSES = (
    ("Customer", "c_mktsegment", "BUILDING", "BuildingCustomer"), ("Order", "o_orderpriority", "1-URGENT", "UrgentOrder"),
    ("Order", "o_orderstatus", "O", "OpenOrder"), ("Order", "o_orderstatus", "F", "FinishedOrder"), ("Order", "o_orderstatus", "P", "PendingOrder"),
    *(("Event", "event_type", t, f"{t.capitalize()}Event") for t in ("click", "error", "purchase", "signup", "view")),
    *(("Document", "lang", x, f"{n}Document") for x, n in (("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French"))),
)
#: Object properties: name, table, subject kind and column, object kind and column, whose row it is, inverse.
OBJECTS = (
    ("inRegion", "nation", "nation", "n_nationkey", "region", "n_regionkey", "s", None),
    ("inNation", "customer", "customer", "c_custkey", "nation", "c_nationkey", "s", None),
    ("basedIn", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "s", None),
    ("placedBy", "orders", "order", "o_orderkey", "customer", "o_custkey", "s", "placed"),
    ("partOfOrder", "lineitem", "lineitem", "", "order", "l_orderkey", "s", "hasLine"),
    ("ofPart", "lineitem", "lineitem", "", "part", "l_partkey", "s", None),
    ("suppliedBy", "lineitem", "lineitem", "", "supplier", "l_suppkey", "s", None),
)
#: Data properties: name, table, column, datatype.
DATA = (
    ("acctbal", "customer", "c_acctbal", "double"), ("acctbal", "supplier", "s_acctbal", "double"), ("customerName", "customer", "c_name", "string"), ("segment", "customer", "c_mktsegment", "string"),
    ("totalprice", "orders", "o_totalprice", "double"), ("status", "orders", "o_orderstatus", "string"), ("priority", "orders", "o_orderpriority", "string"), ("orderdate", "orders", "o_orderdate", "dateTime"),
    ("size", "part", "p_size", "integer"), ("brand", "part", "p_brand", "string"), ("partName", "part", "p_name", "string"), ("partType", "part", "p_type", "string"), ("retailprice", "part", "p_retailprice", "double"),
    ("quantity", "lineitem", "l_quantity", "double"), ("extendedprice", "lineitem", "l_extendedprice", "double"), ("discount", "lineitem", "l_discount", "double"), ("shipdate", "lineitem", "l_shipdate", "dateTime"),
    ("eventValue", "events", "value", "double"), ("n_chars", "documents", "n_chars", "integer"), ("lang", "documents", "lang", "string"), ("nationName", "nation", "n_name", "string"), ("regionName", "region", "r_name", "string"),
)


def line_key() -> Column:
    """A unique key of a line item; (order, line number) is not unique in these tables."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


def star_graph(spark: SparkSession, sf_dir: str) -> MappedGraph:
    """The mapped graph over a folder of tables; only the tables that a query touches are read."""
    frames: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    g = MappedGraph()
    kind_of = {t: KIND_NAMES.get(t, t) for _, t, _ in KINDS} | {"lineitem": "lineitem"}
    for cls, t, key in KINDS:
        g.add_kind(kind_of[t], cls, t, partial(table, t), F.col(key))
    g.add_kind("lineitem", "LineItem", "lineitem", partial(table, "lineitem"), line_key(), "string")
    for parent, column, value, cls in SUBCLASSES:
        g.add_class(cls, parent, F.col(column) == value)
    for name, t, s_kind, s, o_kind, o, row, inverse in OBJECTS:
        subject = F.col(s) if s else line_key()
        g.add_object(name, t, partial(table, t), (s_kind, subject), (o_kind, F.col(o)), row, inverse)
    # customer and supplier share a nation: a property without rows of its own, with a loop for each nation that has both
    def shared() -> DataFrame:
        return table("customer").select("c_nationkey").distinct().join(table("supplier").select("s_nationkey").distinct(), F.col("c_nationkey") == F.col("s_nationkey"))

    g.add_object("tradesWith", "trades", shared, ("nation", F.col("c_nationkey")), ("nation", F.col("s_nationkey")))
    for name, t, column, datatype in DATA:
        g.add_data(name, kind_of[t], F.col(column).cast("decimal(38,0)") if datatype == "integer" else F.col(column), XSD + datatype)
    g.sub_properties["relatedTo"] = ("placedBy", "ofPart", "suppliedBy")
    g.sub_properties["located"] = ("inNation", "basedIn")
    return g

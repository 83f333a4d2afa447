"""The registered ontology queries over the star schema, with SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ontomill.operators.retrieval import Reasoner
from ontomill.plans.syntax import parse_dl
from ontomill.sources.star import star_graph

#: Class expressions in DL syntax by query name, each with its SQL (column ``ind``).
O, C, N, L, P = "'order/' || o_orderkey", "'customer/' || c_custkey", "'nation/' || n_nationkey", "l_orderkey", "'part/' || p_partkey"  # noqa: E741
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "named_class": ("BuildingCustomer", f"SELECT {C} AS ind FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "intersection": ("BuildingCustomer ⊓ ∃ acctbal.xsd:double[> 5000]", f"SELECT {C} AS ind FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "union": ("UrgentOrder ⊔ ∃ totalprice.xsd:double[> 300000]", f"SELECT {O} AS ind FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 300000"),
    "union_of_kinds": ("BuildingCustomer ⊔ OpenOrder", f"SELECT {C} AS ind FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {O} FROM orders WHERE o_orderstatus = 'O'"),
    "complement": ("Order ⊓ ¬(∃ hasLine.⊤)", f"SELECT {O} AS ind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "complement_of_class": ("Customer ⊓ ¬BuildingCustomer", f"SELECT {C} AS ind FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "some_values": ("∃ placed.UrgentOrder", f"SELECT {C} AS ind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "some_values_nested": ("∃ hasLine.(∃ ofPart.(∃ size.xsd:integer[> 40]))", f"SELECT {O} AS ind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40)"),
    "some_thing": ("∃ hasLine.⊤", f"SELECT {O} AS ind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "inverse": ("∃ placed⁻.BuildingCustomer", f"SELECT {O} AS ind FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "all_values": ("Order ⊓ ∀ hasLine.(∃ quantity.xsd:double[> 5])", f"SELECT {O} AS ind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity > 5)"),
    "all_values_joined": ("Order ⊓ ∀ hasLine.(∃ ofPart.(∃ size.xsd:integer[> 5]))", f"SELECT {O} AS ind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND NOT p_size > 5)"),
    "has_value": ("∃ inNation.{nation/7}", f"SELECT {C} AS ind FROM customer WHERE c_nationkey = 7"),
    "one_of": ("{customer/1 ⊔ customer/5 ⊔ customer/999999999}", f"SELECT {C} AS ind FROM customer WHERE c_custkey IN (1, 5, 999999999)"),
    "exists_nominal": ("∃ inRegion.{region/1 ⊔ region/3}", f"SELECT {N} AS ind FROM nation WHERE n_regionkey IN (1, 3)"),
    "has_self": ("∃ tradesWith.Self", f"SELECT {N} AS ind FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "min_card": ("≥ 5 hasLine.⊤", "SELECT 'order/' || l_orderkey AS ind FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5"),
    "min_card_filler": ("≥ 3 hasLine.(∃ quantity.xsd:double[> 5])", "SELECT 'order/' || l_orderkey AS ind FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey HAVING count(*) >= 3"),
    "max_card": ("Order ⊓ ≤ 2 hasLine.⊤", f"SELECT {O} AS ind FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <= 2"),
    "exact_card": ("= 3 hasLine.⊤", "SELECT 'order/' || l_orderkey AS ind FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3"),
    "exact_card_zero": ("Order ⊓ = 0 hasLine.⊤", f"SELECT {O} AS ind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "data_one_of": ("∃ status.{\"F\"^^xsd:string ⊔ \"P\"^^xsd:string}", f"SELECT {O} AS ind FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "data_has_value": ("∃ size.{7}", f"SELECT {P} AS ind FROM part WHERE p_size = 7"),
    "data_complement": ("∃ size.(¬xsd:integer[> 10])", f"SELECT {P} AS ind FROM part WHERE NOT p_size > 10"),
    "data_union": ("∃ size.(xsd:integer[< 5] ⊔ xsd:integer[> 45])", f"SELECT {P} AS ind FROM part WHERE p_size < 5 OR p_size > 45"),
    "data_intersection": ("∃ size.(xsd:integer[≥ 5] ⊓ ¬{7 ⊔ 8})", f"SELECT {P} AS ind FROM part WHERE p_size >= 5 AND p_size NOT IN (7, 8)"),
    "data_all_values": ("Part ⊓ ∀ size.xsd:integer[≤ 25]", f"SELECT {P} AS ind FROM part WHERE p_size <= 25"),
    "data_min_card": ("≥ 1 size.xsd:integer[> 48]", f"SELECT {P} AS ind FROM part WHERE p_size > 48"),
    "data_max_card": ("Part ⊓ ≤ 0 size.xsd:integer[> 48]", f"SELECT {P} AS ind FROM part WHERE NOT p_size > 48"),
    "data_datatype": ("∃ acctbal.xsd:double", f"SELECT {C} AS ind FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal IS NOT NULL"),
    "data_other_datatype": ("∃ size.xsd:double", f"SELECT {P} AS ind FROM part WHERE false"),
    "facet_pattern": ("∃ brand.xsd:string[pattern \"Brand#[12].*\"^^xsd:string]", f"SELECT {P} AS ind FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].*')"),
    "facet_length": ("∃ partName.xsd:string[minLength 6 ⊓ maxLength 8]", f"SELECT {P} AS ind FROM part WHERE length(p_name) BETWEEN 6 AND 8"),
    "facet_range": ("∃ totalprice.xsd:double[≥ 1000.0 ⊓ < 50000.0]", f"SELECT {O} AS ind FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000"),
    "facet_date": ("∃ orderdate.xsd:dateTime[≥ 1995-01-01T00:00:00 ⊓ < 1995-07-01T00:00:00]", f"SELECT {O} AS ind FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01'"),
    "facet_digits": ("∃ size.xsd:integer[totalDigits 1 ⊓ fractionDigits 0]", f"SELECT {P} AS ind FROM part WHERE p_size < 10"),
    "sub_property": ("∃ relatedTo.(Customer ⊓ ∃ acctbal.xsd:double[< 0])", f"SELECT {O} AS ind FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"),
    "sub_property_kinds": ("∃ located.{nation/3}", f"SELECT {C} AS ind FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3"),
    "flagship": ("Customer ⊓ ∃ placed.(Order ⊓ ∃ totalprice.xsd:double[> 300000])", f"SELECT {C} AS ind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "long_chain": ("∃ hasLine.((∃ ofPart.(∃ size.xsd:integer[> 40])) ⊓ (∃ suppliedBy.(∃ basedIn.(∃ inRegion.{region/2}))))", f"SELECT {O} AS ind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 40 AND n_regionkey = 2)"),
}


def retrieve(dl: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Reasoner(star_graph(spark, sf_dir)).instances(parse_dl(dl))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: retrieve(dl) for name, (dl, _) in EXPRESSIONS.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in EXPRESSIONS.items()}

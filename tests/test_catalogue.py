import pytest

from ontomill import catalogue, coverage_catalogue, services_catalogue
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


MODULES = (catalogue, services_catalogue, coverage_catalogue)
QUERIES, SQL = {k: f for m in MODULES for k, f in m.QUERIES.items()}, {k: x for m in MODULES for k, x in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    want = sql_rows(SQL[name], SF)
    assert rows_of(got) == want
    if got.columns == ["ind"]:
        assert len(want) == len(set(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_connected_has_components_to_keep_apart(spark):
    """Every order and customer is there, in a component for each nation that has customers."""
    got = QUERIES["connected"](spark, SF).collect()
    orders, customers = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    nations = customers.select("c_nationkey").distinct().count()
    assert len({r.node for r in got}) == len(got) == orders.count() + customers.count() + nations
    assert len({r.root for r in got}) == nations > 1

import pytest

from tessera.plans import catalogue
from tests.compare import connection, oracle, rows

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(catalogue.queries()[name](spark, sf)) == oracle(duck, catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(NAMES) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", ["dml_upsert", "dml_do_nothing", "dml_insert_select", "dml_rollback", "join_null_keys"])
def test_changes_reach_every_customer(spark, sf, name):
    key = "ka" if name.startswith("join") else "c_custkey"
    got = {r[0] for r in catalogue.queries()[name](spark, sf).select(key).collect()}
    assert {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()} <= got

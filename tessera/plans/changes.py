"""DML as queries: the rows of a table after the statement."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import Database
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables

SCHEMA = "c_custkey bigint, c_nationkey int, c_acctbal double"


def _customers(t: Tables, where: str = "true", **rules: object) -> Database:
    db = Database(t.spark)
    db.create("c", SCHEMA, primary_key=("c_custkey",), **rules)
    db.insert("c", t.customer.where(where).select("c_custkey", "c_nationkey", "c_acctbal"))
    return db


def _again(t: Tables) -> DataFrame:
    """A row for each customer: with the supplier's nation where one has its key, else with a key that no customer has."""
    both = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return both.selectExpr("if(s_suppkey is null, c_custkey + 1000000000, c_custkey) AS c_custkey", "coalesce(s_nationkey, c_nationkey) AS c_nationkey", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + c_nationkey ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t: Tables) -> DataFrame:
    db = _customers(t)
    db.update("c", {"c_nationkey": "c_nationkey + 100", "c_acctbal": "c_acctbal + c_nationkey"}, "c_nationkey = 3")
    return db.table("c")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0) AND c_nationkey <> 4")
def dml_delete(t: Tables) -> DataFrame:
    db = _customers(t)
    db.delete("c", "c_acctbal < 0")
    db.delete("c", "c_nationkey = 4")
    return db.table("c")


@query("SELECT s_suppkey AS c_custkey, CAST(7 AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM supplier")
def dml_defaults(t: Tables) -> DataFrame:
    db = _customers(t, "false", defaults={"c_nationkey": 7})
    db.insert("c", t.supplier.select("s_suppkey"), ["c_custkey"])
    return db.table("c")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -900")
def dml_returning(t: Tables) -> DataFrame:
    return _customers(t).delete("c", "c_acctbal < -900").select("c_custkey", "c_acctbal")


@query("""
    SELECT c_custkey, coalesce(s_nationkey + 1000, c_nationkey) AS c_nationkey, c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
    UNION ALL SELECT c_custkey + 1000000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def dml_upsert(t: Tables) -> DataFrame:
    """All customers meet all of them again: under their own key where a supplier has it too, else under a new one."""
    db = _customers(t)
    db.upsert("c", _again(t), update={"c_nationkey": "excluded.c_nationkey + 1000"})
    return db.table("c")


@query("""
    SELECT c_custkey, c_nationkey, c_acctbal FROM customer
    UNION ALL SELECT c_custkey + 1000000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def dml_do_nothing(t: Tables) -> DataFrame:
    db = _customers(t)
    db.upsert("c", _again(t))
    return db.table("c")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_nationkey, s_acctbal FROM supplier")
def dml_insert_select(t: Tables) -> DataFrame:
    db = _customers(t)
    db.insert("c", t.supplier.selectExpr("s_suppkey + 1000000000", "s_nationkey", "s_acctbal"), ["c_custkey", "c_nationkey", "c_acctbal"])
    return db.table("c")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def dml_rollback(t: Tables) -> DataFrame:
    db = _customers(t)
    db.begin()
    db.delete("c", "c_acctbal < 0")
    db.update("c", {"c_acctbal": "0"})
    db.rollback()
    return db.table("c")

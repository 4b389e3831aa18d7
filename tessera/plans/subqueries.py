"""Subqueries, common table expressions, views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import not_in
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


def _sql(t: Tables, text: str, *names: str) -> DataFrame:
    """Spark SQL over the folder's own tables, given as arguments instead of named views."""
    return t.spark.sql(text, **{n: getattr(t, n) for n in names})


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sub_in(t: Tables) -> DataFrame:
    return _sql(t, "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')", "orders", "customer")


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 5) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def sub_not_in(t: Tables) -> DataFrame:
    return not_in(t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(5)).alias("k")), "k", t.supplier.where("s_acctbal > 0"), "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 2) FROM supplier)")
def sub_not_in_null(t: Tables) -> DataFrame:
    return _sql(t, "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 2) FROM {supplier})", "customer", "supplier")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 9000)")
def sub_exists(t: Tables) -> DataFrame:
    return _sql(t, "SELECT n_name FROM {nation} WHERE EXISTS (SELECT 1 FROM {supplier} WHERE s_acctbal > 9000)", "nation", "supplier")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def sub_not_exists(t: Tables) -> DataFrame:
    return _sql(t, "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 40)", "part", "lineitem")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def sub_scalar(t: Tables) -> DataFrame:
    return _sql(t, "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", "orders")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def sub_correlated(t: Tables) -> DataFrame:
    return _sql(t, "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")


@query("SELECT segment, max(n) AS most FROM (SELECT c_mktsegment AS segment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) AS d GROUP BY segment")
def derived_table(t: Tables) -> DataFrame:
    inner = t.customer.groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey").agg(F.count(F.lit(1)).alias("n")).alias("d")
    return inner.groupBy("segment").agg(F.max("n").alias("most"))


@query("""
    WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 2000000)
    SELECT c_custkey, c_name FROM customer JOIN top ON k = c_custkey UNION ALL SELECT -1, 'none'""")
def cte_chain(t: Tables) -> DataFrame:
    return _sql(t, """
        WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM {orders} GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 2000000)
        SELECT c_custkey, c_name FROM {customer} JOIN top ON k = c_custkey UNION ALL SELECT -1L, 'none'""", "orders", "customer")  # fmt: skip


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def cte_recursive(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("SELECT n_name, s FROM (SELECT n_name, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) WHERE s > 0")
def view_query(t: Tables) -> DataFrame:
    t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("s")).createOrReplaceTempView("nation_balance")
    return t.spark.sql("SELECT n_name, s FROM nation_balance WHERE s > 0")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17 AND o_totalprice > 1000.0")
def parameters(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("_param_orders")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM _param_orders WHERE o_custkey = ? AND o_totalprice > ?", args=[17, 1000.0])

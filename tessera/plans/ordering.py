"""ORDER BY, LIMIT, OFFSET, DISTINCT and DISTINCT ON."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import distinct_on, order, top_k
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_custkey")
def sort_multi_nulls(t: Tables) -> DataFrame:
    return order(t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k")), "-k", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def topk(t: Tables) -> DataFrame:
    return top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), 20, "-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(t: Tables) -> DataFrame:
    return top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, "-o_totalprice", "o_orderkey", offset=25)


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def limit_plain(t: Tables) -> DataFrame:
    return t.orders.limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(t: Tables) -> DataFrame:
    return distinct_on(t.orders, ["o_custkey"], "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")

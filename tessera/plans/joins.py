"""Joins of every kind. Catalyst chooses the strategy; conditions keep their residual predicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import anti, full_join, range_join, semi
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def join_left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def join_full(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey < 5").join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def join_theta_range(t: Tables) -> DataFrame:
    spans = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return range_join(t.part, spans, "p_retailprice", "low", "high", 10.0).select("s_suppkey", "p_partkey")


@query("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey > r_regionkey + 2")
def join_theta_outer(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") > F.col("r_regionkey") + 2, "left").select("n_nationkey", "r_regionkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4")
def join_equi_residual(t: Tables) -> DataFrame:
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > F.col("o_totalprice") / 4)
    return t.lineitem.join(t.orders, on, "left").select("l_orderkey", "l_linenumber", "l_partkey", "o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey FROM lineitem a JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.m")
def join_multikey(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("m"))
    return t.lineitem.join(last, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") == F.col("m"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_name, c_custkey FROM customer JOIN nation ON c_nationkey + 1 = n_nationkey")
def join_expression_key(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") + 1 == F.col("n_nationkey")).select("n_name", "c_custkey")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def join_using(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, ["doc_id"]).select("doc_id", "n_chars", "quality")


@query("SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels")
def join_natural(t: Tables) -> DataFrame:
    docs, labels = t.documents, t.labels
    return docs.join(labels, [c for c in docs.columns if c in labels.columns]).select("doc_id", "lang", "toxic")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(t: Tables) -> DataFrame:
    return semi(t.customer, t.orders.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return anti(t.customer, t.orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name < 'F'")
def join_3way(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation.where("n_name < 'F'"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) l ON o_orderkey = l_orderkey) ON c_custkey = o_custkey")
def join_nested(t: Tables) -> DataFrame:
    inner = t.orders.join(t.lineitem.where("l_quantity > 49").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"))
    return t.customer.join(inner, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT a.c_custkey AS ka, b.s_suppkey AS kb FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a FULL JOIN (SELECT s_suppkey, nullif(s_nationkey, 4) AS k FROM supplier) b ON a.k = b.k")
def join_null_keys(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("ka"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("ak"))
    b = t.supplier.select(F.col("s_suppkey").alias("kb"), F.nullif(F.col("s_nationkey"), F.lit(4)).alias("bk"))
    return full_join(a, b, "ak", "bk").select("ka", "kb")

"""Aggregates, with DISTINCT, FILTER and HAVING."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


@query("SELECT count(*) AS n, count(nullif(l_linenumber, 3)) AS nn, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem")
def agg_global(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("l_linenumber"), F.lit(3))).alias("nn"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_discount"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_returnflag").alias("hi"))


@query("SELECT count(*) AS n, count(l_quantity) AS c, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo, count(DISTINCT l_quantity) AS d FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.where(q < 0).agg(F.count(F.lit(1)).alias("n"), F.count(q).alias("c"), F.sum(q).alias("s"), F.avg(q).alias("a"), F.min(q).alias("lo"), F.count_distinct(q).alias("d"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY nullif(c_nationkey, 3)")
def agg_group_nulls(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")).where("n > 12 AND s > 1000").withColumn("s", F.round("s", 2))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
def agg_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("d"), F.sum_distinct("l_linenumber").alias("s"), F.round(F.expr("avg(DISTINCT l_quantity)"), 6).alias("a"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS d, count(DISTINCT o_orderpriority) AS p, round(max(o_totalprice), 2) AS m FROM orders GROUP BY o_orderstatus")
def agg_mixed_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("d"), F.count_distinct("o_orderpriority").alias("p"), F.round(F.max("o_totalprice"), 2).alias("m"))


@query("SELECT c_mktsegment, bool_and(c_acctbal > -900) AS every_, bool_or(c_acctbal > 9900) AS some_ FROM customer GROUP BY c_mktsegment")
def agg_bool(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.bool_and(F.col("c_acctbal") > -900).alias("every_"), F.bool_or(F.col("c_acctbal") > 9900).alias("some_"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("_agg_string")
    return t.spark.sql("SELECT n_regionkey, string_agg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM _agg_string GROUP BY n_regionkey")


@query("SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def agg_array(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_ FROM orders GROUP BY o_custkey")
def agg_first_last(t: Tables) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_"), F.max_by("o_orderkey", at).alias("last_"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS s FROM lineitem GROUP BY l_returnflag")
def agg_filter(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_tax"))), 4).alias("s"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / count(*), 4) AS r, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_suppkey")
def agg_expr_over_agg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.count(F.lit(1)), 4).alias("r"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@query("SELECT extract(year FROM o_orderdate) AS y, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_expr(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.when(F.col("o_totalprice") > 150000, "big").otherwise("small").alias("size")).agg(F.count(F.lit(1)).alias("n"))


# Beyond the inventory: Spark has them.
@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))

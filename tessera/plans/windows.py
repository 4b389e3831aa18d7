"""Window functions with real orderings, ties and frames."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import groups_frame, over, unordered_row_number
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


def _long(c):
    return c.cast("bigint")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", _long(F.row_number().over(over(["o_custkey"], "o_orderdate", "o_orderkey"))).alias("rn"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part")
def win_row_number_all(t: Tables) -> DataFrame:
    return unordered_row_number(t.part.select("p_partkey"), "rn", "p_partkey").select("p_partkey", "rn")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part")
def win_rank_dense(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _long(F.rank().over(over(["p_brand"], "p_size"))).alias("r"), _long(F.dense_rank().over(over(["p_brand"], "-p_size"))).alias("d"))


@query("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS c FROM part")
def win_percent_cume(t: Tables) -> DataFrame:
    w = over(["p_brand"], "p_size")
    return t.part.select("p_partkey", F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"))


@query("SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS b FROM part")
def win_ntile(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _long(F.ntile(4).over(over(["p_brand"], "p_size", "p_partkey"))).alias("b"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, lag(o_orderkey, 1, -1) OVER w AS id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(t: Tables) -> DataFrame:
    w = over(["o_custkey"], "o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2).over(w).alias("after"), F.lag("o_orderkey", 1, -1).over(w).alias("id"))


@query("""
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(t: Tables) -> DataFrame:
    w = over(["o_custkey"], "o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.first_value(k).over(w).alias("f"), F.last_value(k).over(w).alias("l"), F.nth_value(k, 2).over(w).alias("n"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")
def win_partition_sum(t: Tables) -> DataFrame:
    w = over(["o_custkey"])
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.max("o_totalprice").over(w).alias("m"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s FROM orders")
def win_running_sum(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(over(["o_custkey"], "o_orderdate", "o_orderkey")), 2).alias("s"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
def win_rows_frame(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(over(["o_custkey"], "o_orderdate", "o_orderkey").rowsBetween(-2, 1)), 4).alias("a"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
def win_range_frame(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.count(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 2)).alias("n"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def win_groups_frame(t: Tables) -> DataFrame:
    return groups_frame(t.part, F.count(F.lit(1)), "n", ["p_brand"], "p_size", 1, 1).select("p_partkey", "n")

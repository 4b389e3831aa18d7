"""Decision-support queries, adapted to the columns at hand."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import top_k
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


def _revenue():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q1(t: Tables) -> DataFrame:
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("sum_base"),
        F.round(F.sum(price * (1 - off)), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 - off) * (1 + tax)), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg(off), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("""
    SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
    GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def tpch_q3(t: Tables) -> DataFrame:
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    orders = t.orders.where(F.col("o_orderdate") < day).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = t.lineitem.where(F.col("l_shipdate") > day).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return top_k(rows.groupBy("o_orderkey", "o_orderdate").agg(F.round(_revenue(), 2).alias("revenue")), 10, "-revenue", "o_orderkey")


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
         JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name""")
def tpch_q5(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t.orders.where((F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    buyers = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = t.lineitem.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(_revenue(), 2).alias("revenue"))


@query("""
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.0499 AND 0.0701 AND l_quantity < 24""")
def tpch_q6(t: Tables) -> DataFrame:
    d = F.col("l_shipdate")
    rows = t.lineitem.where((d >= F.lit("1994-01-01").cast("timestamp_ntz")) & (d < F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.0499, 0.0701) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""
    SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' GROUP BY 1, 2, 3 ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_q10(t: Tables) -> DataFrame:
    # revenue by customer first: names join 20 rows only
    back = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    best = top_k(back.groupBy("o_custkey").agg(F.round(_revenue(), 2).alias("revenue")), 20, "-revenue", "o_custkey")
    return best.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "revenue")

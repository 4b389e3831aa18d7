"""Set operations: columns by position, names from the left, NULLs equal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import top_k
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables

LEFT = "SELECT nullif(c_nationkey, 3) AS k FROM customer"
RIGHT = "SELECT nullif(s_nationkey, 3) AS k FROM supplier WHERE s_nationkey > 2"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    three = F.lit(3)
    return t.customer.select(F.nullif(F.col("c_nationkey"), three).alias("k")), t.supplier.where("s_nationkey > 2").select(F.nullif(F.col("s_nationkey"), three).alias("k"))


@query(f"{LEFT} UNION ALL {RIGHT}")
def union_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.union(b)


@query(f"{LEFT} UNION {RIGHT}")
def union_distinct(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.union(b).distinct()


@query(f"{LEFT} INTERSECT {RIGHT}")
def intersect(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.intersect(b)


@query(f"{LEFT} INTERSECT ALL {RIGHT}")
def intersect_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.intersectAll(b)


@query(f"{LEFT} EXCEPT {RIGHT}")
def except_(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.subtract(b)


@query(f"{LEFT} EXCEPT ALL {RIGHT}")
def except_all(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.exceptAll(b)


@query(f"SELECT k FROM (({LEFT} UNION {RIGHT}) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY k NULLS LAST LIMIT 7 OFFSET 2")
def setop_nested_order_limit(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return top_k(a.union(b).distinct().subtract(t.nation.where("n_regionkey = 1").select("n_nationkey")), 7, "k", offset=2)

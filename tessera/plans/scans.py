"""Scans, filters, predicates, CASE, CAST and operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_project(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_quantity") > 45).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def index_scan(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_custkey") == 7).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <> 0 AND c_acctbal >= 1000 AND c_acctbal < 5000 AND c_custkey <= 1000 AND c_nationkey = 3")
def filter_compare(t: Tables) -> DataFrame:
    c = F.col("c_acctbal")
    return t.customer.where((c != 0) & (c >= 1000) & (c < 5000) & (F.col("c_custkey") <= 1000) & (F.col("c_nationkey") == 3)).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT p_retailprice BETWEEN 1000 AND 1500")
def filter_between(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").between(10, 20) & ~F.col("p_retailprice").between(1000, 1500)).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND nullif(c_nationkey, 5) IN (1, 2, NULL, 9)")
def filter_in(t: Tables) -> DataFrame:
    nation = F.nullif(F.col("c_nationkey"), F.lit(5))
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & nation.isin(1, 2, None, 9)).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 5) NOT IN (1, 2, 3)")
def filter_not_in(t: Tables) -> DataFrame:
    return t.customer.where(~F.nullif(F.col("c_nationkey"), F.lit(5)).isin(1, 2, 3)).select("c_custkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%1_' AND p_type NOT LIKE 'S%'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").like("%1_") & ~F.col("p_type").like("S%")).select("p_partkey", "p_name", "p_type")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%g' AND c_name NOT ILIKE '%9'")
def filter_ilike(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").ilike("b%g") & ~F.col("c_name").ilike("%9")).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')")
def filter_regex(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").rlike("^[12]-")).select("o_orderkey")


@query("""
    SELECT c_custkey, x > 10 AS gt, x IS NULL AS isnull, (x > 10 AND x < 20) AS both_, (x > 10 OR x IS NULL) AS either_, NOT (x = 4) AS negated
    FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS x FROM customer) WHERE NOT (x > 12) OR x IS NULL""")
def filter_null_3vl(t: Tables) -> DataFrame:
    x = F.col("x")
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("x")).where(~(x > 12) | x.isNull())
    return rows.select("c_custkey", (x > 10).alias("gt"), x.isNull().alias("isnull"), ((x > 10) & (x < 20)).alias("both_"), ((x > 10) | x.isNull()).alias("either_"), (~(x == 4)).alias("negated"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS state FROM orders")
def case_simple(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", "final").when(s == "O", "open").alias("state"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'mid' ELSE 'low' END AS band FROM lineitem")
def case_searched(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(d >= 0.08, "high").when(d >= 0.04, "mid").otherwise("low").alias("band"))


@query("""
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST('1' || CAST(o_custkey AS VARCHAR) AS BIGINT) AS b,
           CAST(o_orderdate AS DATE) AS d, o_custkey <> 0 AS f, CAST(o_custkey AS DOUBLE) AS x, CAST(o_custkey AS DECIMAL(12, 2)) AS n FROM orders""")
def cast_types(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return t.orders.select("o_orderkey", k.cast("int").alias("i"), F.col("o_orderkey").cast("string").alias("s"), S.concat_op(F.lit("1"), k).cast("bigint").alias("b"), F.col("o_orderdate").cast("date").alias("d"), k.cast("boolean").alias("f"), k.cast("double").alias("x"), k.cast("decimal(12,2)").alias("n"))


@query("SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 12 AS o, xor(c_custkey, 12) AS x, ~c_custkey AS n FROM customer")
def bitwise_ops(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(12).alias("o"), k.bitwiseXOR(12).alias("x"), F.bitwise_not(k).alias("n"))


@query("SELECT o_orderkey, CAST((o_custkey - 700) // 7 AS BIGINT) AS q, CAST((o_custkey - 700) % 7 AS BIGINT) AS r, -o_custkey AS neg, +o_custkey AS pos FROM orders")
def int_division(t: Tables) -> DataFrame:
    k = F.col("o_custkey") - 700
    return t.orders.select("o_orderkey", S.int_div(k, F.lit(7)).alias("q"), (k % 7).cast("bigint").alias("r"), (-F.col("o_custkey")).alias("neg"), F.col("o_custkey").alias("pos"))


@query("SELECT c_custkey, c_name || '/' || c_custkey || '/' || c_mktsegment AS label, c_acctbal + 1.5 AS plus, c_acctbal * 2.0 AS twice, c_acctbal - 1.0 AS minus, c_acctbal / 4.0 AS quarter FROM customer")
def arithmetic_concat(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", S.concat_op(F.col("c_name"), F.lit("/"), F.col("c_custkey"), F.lit("/"), F.col("c_mktsegment")).alias("label"), (b + 1.5).alias("plus"), (b * 2.0).alias("twice"), (b - 1.0).alias("minus"), (b / 4.0).alias("quarter"))


@query("SELECT 1 AS one, 'a' AS a, CAST(NULL AS INTEGER) AS nothing")
def empty_relation(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("a").alias("a"), F.lit(None).cast("int").alias("nothing"))


@query("SELECT c_custkey FROM customer WHERE 1 = 0")
def filter_contradiction(t: Tables) -> DataFrame:
    return t.customer.where(F.lit(1) == 0).select("c_custkey")


@query("SELECT * FROM (VALUES (1, 'x', 1.5), (2, NULL, 2.5), (3, 'z', NULL)) AS v(id, name, amount)")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT id, name, CAST(amount AS DECIMAL(2,1)) AS amount FROM VALUES (1, 'x', 1.5), (2, NULL, 2.5), (3, 'z', NULL) AS v(id, name, amount)")

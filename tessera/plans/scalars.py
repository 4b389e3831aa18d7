"""Scalar functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS BIGINT) AS n, strlen(p_type) AS bytes, reverse(p_brand) AS r, repeat(p_brand, 2) AS twice FROM part")
def str_case_len(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.length("p_name").cast("bigint").alias("n"), F.octet_length("p_type").cast("bigint").alias("bytes"), F.reverse("p_brand").alias("r"), F.repeat("p_brand", 2).alias("twice"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS mid, substr(p_name, 3) AS rest, CAST(strpos(p_name, '1') AS BIGINT) AS at_, left(p_name, 4) AS l, right(p_name, 3) AS r FROM part")
def str_substr_pos(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", S.substr(n, 2, 3).alias("mid"), S.substr(n, 3).alias("rest"), S.strpos(n, "1").alias("at_"), F.left(n, F.lit(4)).alias("l"), F.right(n, F.lit(3)).alias("r"))


@query("SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS b, ltrim('  ' || c_mktsegment) AS l, rtrim(c_mktsegment || '  ') AS r, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS lp, rpad(c_mktsegment, 12, 'xy') AS rp FROM customer")
def str_trim_pad(t: Tables) -> DataFrame:
    m = F.col("c_mktsegment")
    return t.customer.select("c_custkey", S.trim_all(S.concat_op(F.lit("  "), m, F.lit(" "))).alias("b"), S.ltrim_all(S.concat_op(F.lit("  "), m)).alias("l"), S.rtrim_all(S.concat_op(m, F.lit("  "))).alias("r"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("lp"), F.rpad(m, 12, "xy").alias("rp"))


@query("SELECT o_orderkey, replace(o_orderpriority, '-', '_') AS rep, split_part(o_orderpriority, '-', 1) AS p1, split_part(o_orderpriority, '-', 2) AS p2, split_part(o_orderpriority, '-', 9) AS p9 FROM orders")
def str_replace_split(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.replace(p, F.lit("-"), F.lit("_")).alias("rep"), S.split_part(p, "-", 1).alias("p1"), S.split_part(p, "-", 2).alias("p2"), S.split_part(p, "-", 9).alias("p9"))


@query("SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS skipped, c_name || nullif(c_mktsegment, 'BUILDING') AS strict FROM customer")
def str_concat(t: Tables) -> DataFrame:
    m = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select("c_custkey", S.concat_skip_nulls(F.col("c_name"), m, F.col("c_nationkey")).alias("skipped"), S.concat_op(F.col("c_name"), m).alias("strict"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, abs(l_quantity - 25) AS a FROM lineitem")
def math_round(t: Tables) -> DataFrame:
    e = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.round_half_up(e * (1 - F.col("l_discount")), 2).alias("net"), F.ceil(e).alias("c"), F.floor(e).alias("f"), F.abs(F.col("l_quantity") - 25).alias("a"))


@query("SELECT p_partkey, power(p_size, 2) AS p, p_partkey % 7 AS m, round(sqrt(p_retailprice), 4) AS s FROM part")
def math_power_mod(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.pow(F.col("p_size"), F.lit(2)).alias("p"), (F.col("p_partkey") % 7).alias("m"), F.round(S.sqrt_strict(F.col("p_retailprice")), 4).alias("s"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS co, nullif(c_mktsegment, 'BUILDING') AS nu FROM customer")
def null_funcs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit(-1)).alias("co"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("nu"))


@query("SELECT c_custkey, greatest(c_nationkey, nullif(12, c_nationkey)) AS g, least(c_nationkey, 12, NULL) AS l FROM customer")
def greatest_least(t: Tables) -> DataFrame:
    n = F.col("c_nationkey")
    return t.customer.select("c_custkey", F.greatest(n, F.nullif(F.lit(12), n)).alias("g"), F.least(n, F.lit(12), F.lit(None).cast("int")).alias("l"))


@query("""
    SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS mo, extract(day FROM ts) AS d, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi,
           CAST(floor(extract(second FROM ts)) AS BIGINT) AS s, extract(dow FROM ts) AS dow, extract(doy FROM ts) AS doy, extract(quarter FROM ts) AS q, extract(week FROM ts) AS w,
           CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events""")
def date_extract(t: Tables) -> DataFrame:
    ts = F.col("ts")
    part = lambda name: F.date_part(F.lit(name), ts).cast("bigint")
    return t.events.select("event_id", part("year").alias("y"), part("month").alias("mo"), part("day").alias("d"), part("hour").alias("h"), part("minute").alias("mi"), F.floor(F.date_part(F.lit("second"), ts)).cast("bigint").alias("s"), S.dow(ts).alias("dow"), part("doy").alias("doy"), part("quarter").alias("q"), part("week").alias("w"), S.epoch(ts).alias("e"))


@query("""
    SELECT event_id, CAST(date_trunc('year', ts) AS TIMESTAMP) AS y, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, CAST(date_trunc('month', ts) AS TIMESTAMP) AS mo, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w,
           CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS mi FROM events""")
def date_trunc(t: Tables) -> DataFrame:
    fields = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "d": "day", "h": "hour", "mi": "minute"}
    return t.events.select("event_id", *(S.truncate(f, F.col("ts")).alias(k) for k, f in fields.items()))


@query("SELECT count(*) FILTER (WHERE r >= 0 AND r < 1) AS in_range, count(DISTINCT u) = count(*) AS all_new, min(length(CAST(u AS VARCHAR))) AS n FROM (SELECT random() AS r, uuid() AS u FROM customer)")
def random_uuid(t: Tables) -> DataFrame:
    rows = t.customer.select(F.rand().alias("r"), F.expr("uuid()").alias("u"))
    return rows.agg(F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"), (F.count_distinct("u") == F.count(F.lit(1))).alias("all_new"), F.min(F.length("u")).cast("bigint").alias("n"))


@query("SELECT current_date IS NOT NULL AND now() IS NOT NULL AND current_time IS NOT NULL AS ok, version() IS NOT NULL AS v")
def now_version(t: Tables) -> DataFrame:
    return t.spark.range(1).select((F.current_date().isNotNull() & F.now().isNotNull() & F.expr("current_time() is not null")).alias("ok"), F.version().isNotNull().alias("v"))

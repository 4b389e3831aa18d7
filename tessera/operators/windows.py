"""Window helpers: orderings with the dialect's NULL order, frames, and the GROUPS frame that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.scalar import asc, desc


def over(partition: list[str] | None = None, *keys: str) -> WindowSpec:
    w = Window.partitionBy(*(partition or []))
    return w.orderBy(*(desc(k[1:]) if k.startswith("-") else asc(k) for k in keys)) if keys else w


def groups_frame(df: DataFrame, value: Column, name: str, partition: list[str], key: str, before: int, after: int) -> DataFrame:
    """GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a dense rank numbers the peers, a RANGE frame runs over it."""
    ranked = df.withColumn("_g", F.dense_rank().over(over(partition, key)))
    frame = Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after)
    return ranked.withColumn(name, value.over(frame)).drop("_g")


def unordered_row_number(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """ROW_NUMBER() OVER (): numbers 1..n in the order of the keys, without moving all rows to one task.

    Rows are sorted in ranges; each range adds the count of those before it."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each partition: safe to broadcast
    return ranged.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")

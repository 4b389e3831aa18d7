import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import vectors as V
from tessera.operators import relational
from tessera.operators.knn import VectorIndex, knn, knn_join
from tessera.operators.relational import full_join, not_in, range_join
from tessera.plans import catalogue
from tessera.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_edges(spark):
    lit = F.lit
    assert one(spark, S.int_div(lit(-7), lit(2))) == -3 and one(spark, S.int_div(lit(7), lit(2))) == 3
    assert one(spark, S.concat_skip_nulls(lit("a"), lit(None), lit(3))) == "a3"
    assert one(spark, S.concat_op(lit("a"), lit(None))) is None
    assert one(spark, S.substr(lit("hello"), 0, 2)) == "he" and one(spark, S.substr(lit("hello"), -2)) == ""
    assert one(spark, S.split_part(lit("a,b"), ",", 0)) == "a" and one(spark, S.split_part(lit("a,b"), ",", 5)) == ""
    assert one(spark, S.strpos(lit("hello"), "l")) == 3 and one(spark, S.strpos(lit("hello"), "z")) == 0
    assert one(spark, S.trim_all(lit("\t\n a \r"))) == "a"
    assert one(spark, S.dow(lit("2026-11-25").cast("timestamp"))) == 3
    assert one(spark, S.vector_of(lit("[1.0, 2]"))) == [1.0, 2.0]
    for bad in (S.sqrt_strict(lit(-1.0)), S.int_div(lit(1), lit(0)), S.vector_of(lit("[1, x]")), S.vector_of(lit('[1, "NaN"]'))):
        with pytest.raises(Exception):
            one(spark, bad)


def test_not_in_three_valued(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(r.k for r in not_in(left, "k", spark.createDataFrame([(1,)], "o int"), "o").collect()) == [2]
    assert not_in(left, "k", spark.createDataFrame([(1,), (None,)], "o int"), "o").count() == 0
    assert not_in(left, "k", spark.createDataFrame([], "o int"), "o").count() == 3


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).select((F.col("id") * 0.7).alias("p"))
    spans = spark.range(40).select((F.col("id") * 3.1).alias("low"), (F.col("id") * 3.1 + F.col("id") % 7).alias("high"))
    want = points.crossJoin(spans).where("p between low and high")
    assert sorted(map(tuple, range_join(points, spans, "p", "low", "high", 4.0).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_full_join_of_left_join_and_rest(spark, sf, monkeypatch, broadcast):
    """Equal to Spark's own full join, which deals all rows of a key to one task; the query no longer has one."""
    if not broadcast:
        monkeypatch.setattr(relational, "small", lambda df: df)
    a = spark.createDataFrame([(i, [None, 1, 2, 3, 1][i % 5]) for i in range(40)] + [(7, 1)], "ka int, ak int")
    b = spark.createDataFrame([(i, [None, 1, 2, 9][i % 4]) for i in range(30)] + [(1, 1)], "kb int, bk int")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(full_join(a, b, "ak", "bk")) == plain(a.join(b, F.col("ak") == F.col("bk"), "full"))
    assert plain(full_join(a.where("false"), b, "ak", "bk")) == plain(a.where("false").join(b, F.col("ak") == F.col("bk"), "full"))
    assert plain(full_join(a, b.where("false"), "ak", "bk")) == plain(a.join(b.where("false"), F.col("ak") == F.col("bk"), "full"))
    assert "FullOuter" not in catalogue.queries()["join_null_keys"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index, hits = VectorIndex(16, centroids=8).build(df), 0
    for _, q in rows[:5]:
        hits += len({r.vec_id for r in index.search(q, 10, probes=5).collect()} & {r.vec_id for r in knn(df, q, 10).collect()})
    assert hits / 50 >= 0.7
    index.delete(spark.createDataFrame([(0,)], "vec_id long"))
    assert 0 not in {r.vec_id for r in index.search(rows[0][1], 10, probes=8).collect()}
    index.insert(spark.createDataFrame([(0, rows[0][1])], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        index.insert(spark.createDataFrame([(1, rows[1][1])], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        index.search([1.0], 3)
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    assert again.search(rows[3][1], 1, probes=8).first().vec_id == 3
    assert sum(r.rows for r in again.stats().collect()) == 200


def test_vector_index_recall_of_all_queries(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = table.where("vec_id % 50 = 0")
    want = {(r.query_id, r.vec_id) for r in knn_join(asked, table, 10).collect()}
    index = VectorIndex(64).build(table)
    got = {(r.query_id, r.vec_id) for r in index.search_all(asked, 10).collect()}
    assert len(want) == 10 * asked.count() and len(got & want) / len(want) >= 0.9
    one = asked.orderBy("vec_id").first()
    assert [r.vec_id for r in index.search(one.embedding, 10).collect()] == [r.vec_id for r in knn(table, one.embedding, 10).collect()]
    cosine = {(r.query_id, r.vec_id) for r in VectorIndex(64, metric="cosine").build(table).search_all(asked, 10, probes=1).collect()}
    assert cosine == {(r.query_id, r.vec_id) for r in knn_join(asked, table, 10, "cosine").collect()}


def joins(df):
    """The names of the columns that each join of the plan gives."""
    plan, out = [df._jdf.queryExecution().optimizedPlan()], []
    while plan:
        node = plan.pop()
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "Join":
            out.append([node.output().apply(i).name() for i in range(node.output().size())])
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_searches_in_blocks_and_keeps_ties(spark, metric):
    """Only k rows of a query leave a block, so no join makes all pairs; equal vectors come by id."""
    rng = np.random.default_rng(9)
    few = rng.standard_normal((12, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, few[i % 12].tolist() if i % 3 else rng.standard_normal(8).tolist()) for i in range(400)] + [(1000, None)], "vec_id long, embedding array<float>").repartition(3)
    found = VectorIndex(8, centroids=5, metric=metric).build(df).search_all(df.where("vec_id % 40 = 0"), 6, probes=1, blocks=3)
    pairs = df.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).crossJoin(df).withColumn("distance", V.vector_distance(F.col("embedding"), F.col("q"), metric)).where("distance is not null")
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 6").select("query_id", "rank", "vec_id", "distance")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "_v" not in [c for j in joins(found) for c in j]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip", "manhattan"])
def test_knn_join_in_blocks_equals_all_pairs(spark, metric):
    """Equal to the last bit, ties by id, over batches of queries too; no join makes all pairs."""
    rng = np.random.default_rng(4)
    few = rng.standard_normal((10, 5)).astype(np.float32)
    vectors = [few[i % 10].tolist() if i % 3 else (rng.standard_normal(5) * 10.0 ** rng.integers(-3, 9)).tolist() for i in range(300)]
    df = spark.createDataFrame([*enumerate(vectors), (300, [0.0] * 5), (301, None), (350, [1.0, None, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 25 = 0")
    found = knn_join(asked, df, 7, metric, blocks=4)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).crossJoin(df).withColumn("distance", V.vector_distance(F.col("embedding"), F.col("q"), metric)).where("distance is not null")
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 7").select("query_id", "vec_id", "distance", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "_v" not in [c for j in joins(found) for c in j]


def test_stream_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    stream = events.tumbling(events.read(spark, f"{sf}/events.parquet*", src.schema))
    q = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("tumbling").collect()))
    assert got == sorted(map(tuple, events.tumbling(src).collect()))

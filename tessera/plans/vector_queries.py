"""Vector functions and nearest neighbours on embeddings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.knn import VectorIndex, knn, knn_join
from tessera.plans.catalogue import query
from tessera.sources.tables import Tables

PROBE = [((i * 37) % 64 - 31.5) / 256 for i in range(64)]
SQL_PROBE = "[" + ", ".join(f"{x!r}" for x in PROBE) + "]::DOUBLE[]"
E = "embedding::DOUBLE[]"


def _at(t: Tables, value) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(value, 6).alias("d"))


@query(f"SELECT vec_id, round(list_distance({E}, {SQL_PROBE}), 6) AS d FROM embeddings")
def vec_l2(t: Tables) -> DataFrame:
    return _at(t, V.l2_distance(F.col("embedding"), V.literal(PROBE)))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity({E}, {SQL_PROBE}), 6) AS d FROM embeddings")
def vec_cosine(t: Tables) -> DataFrame:
    return _at(t, V.cosine_distance(F.col("embedding"), V.literal(PROBE)))


@query(f"SELECT vec_id, round(-list_inner_product({E}, {SQL_PROBE}), 6) AS d FROM embeddings")
def vec_inner(t: Tables) -> DataFrame:
    return _at(t, V.vector_distance(F.col("embedding"), V.literal(PROBE), "ip"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip({E}, {SQL_PROBE}), lambda p: abs(p[1] - p[2]))), 6) AS d FROM embeddings")
def vec_manhattan(t: Tables) -> DataFrame:
    return _at(t, V.vector_distance(F.col("embedding"), V.literal(PROBE), "manhattan"))


@query(f"SELECT vec_id, len(embedding) AS dims, round(sqrt(list_inner_product({E}, {E})), 6) AS size FROM embeddings")
def vec_norm_dims(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", V.dims(F.col("embedding")).alias("dims"), F.round(V.norm(F.col("embedding")), 6).alias("size"))


@query(f"SELECT vec_id, round(list_distance({E}, {SQL_PROBE}), 6) AS distance FROM embeddings ORDER BY list_distance({E}, {SQL_PROBE}), vec_id LIMIT 10")
def knn_exact(t: Tables) -> DataFrame:
    return knn(t.embeddings, PROBE, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
    SELECT query_id, vec_id, rank FROM (
      SELECT q.vec_id AS query_id, r.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(r.{E}, q.{E}), r.vec_id) AS rank
      FROM embeddings q JOIN embeddings r ON true WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def knn_join_query(t: Tables) -> DataFrame:
    return knn_join(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 5).select("query_id", "vec_id", "rank")


@query(f"""
    SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, r.vec_id, list_distance(r.{E}, q.{E}) AS distance
        FROM embeddings q JOIN embeddings r ON true WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def ann_index(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 50 asked of an index of all rows."""
    found = VectorIndex(64).build(t.embeddings).search_all(t.embeddings.where("vec_id % 50 = 0"), 10)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))

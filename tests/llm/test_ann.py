import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, g long"


def brute(rows, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted(((-float(sum(a * b for a, b in zip(q, v))), j) for j, v in ok if j != i))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = queries.op1_nearest(spark, sf).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(want)
    recall = np.mean([len(set(found[q]) & set(want[q])) / len(want[q]) for q in want])
    assert recall >= 0.99


@pytest.mark.parametrize("few", [3, 200])
def test_edges_ties_and_clashing_columns(spark, few):
    rng = np.random.default_rng(1)
    same = [float(x) for x in rng.standard_normal(10)]
    rows = [(i, same if i % 3 == 0 else [float(x) for x in rng.standard_normal(10)]) for i in range(few)]
    rows += [(1000, None), (1020, [0.0] * 10), (1040, [float("nan")] * 10), (1060, [None] + [1.0] * 9), (1080, [1.0] * 4), (1100, [float("inf")] * 10), (None, same)]
    df = spark.createDataFrame([(i, v, 1, "a", "b", 5) for i, v in rows], SCHEMA)
    got = {}
    for r in sorted(nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: ids for q, ids in brute([(i, None if v is None else [np.float32(x) if x is not None else None for x in v]) for i, v in rows if i is not None and (v is None or len(v) == 10)]).items()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(one, F.col("vec_id") % 20 == 0).count() == 0


def test_unusable_rows_of_a_repeated_id_do_not_hide_its_vector(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(6)] + [(20 * i, [1.0, 1.0]) for i in range(1, 6)]
    rows += [(20, []), (40, [None, 1.0]), (60, [0.0, 0.0]), (80, [-9.0]), (100, [float("-inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.query_id for r in nearest(df, F.col("vec_id") % 20 == 0).collect()} == {0, 20, 40, 60, 80, 100}


@pytest.mark.parametrize("size", [1e37, 1e-30])
def test_vectors_whose_squares_overflow_32_bits(spark, size):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x * size)) for x in rng.standard_normal(16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute([(i, [np.float32(x) for x in v]) for i, v in rows])

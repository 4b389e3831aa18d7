from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.exact_dedup import DigestIndex, exact_groups, keep_exact
from tests.compare import connection, oracle, rows


def test_query_equals_sql(spark, sf):
    assert rows(queries.op4_exact_dedup(spark, sf)) == oracle(connection(sf), queries.oracle_sql()["op4_exact_dedup"])


def test_edges(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, "a  b"), (3, "ab"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "a b"), (8, "x"), (8, "x"), (None, "y"), (None, "y"), (9, "y "), (10, "z" * 100_000), (11, "z" * 100_000)]).withColumn("digest", F.lit("q")).withColumn("keep_id", F.lit(-1))
    got = {}
    for r in exact_groups(docs).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(2, 3, False)] and got[2] == [(2, 3, True)] and got[3] == [(2, 3, False)]
    assert got[4] == [(6, 3, False)] and got[5] == [(6, 3, False)] and got[6] == [(6, 3, True)]
    assert got[7] == [(7, 1, True)]
    assert got[8] == [(8, 2, True)] * 2
    assert got[9] == [(9, 3, True)] and got[None] == [(9, 3, False)] * 2
    assert got[11] == [(10, 2, False)]
    kept = keep_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 8, 9, 10]
    assert exact_groups(make_docs([])).count() == 0 and keep_exact(make_docs([])).count() == 0
    assert [r.doc_id for r in keep_exact(make_docs([(None, "a"), (None, "a")])).collect()] == [None]


def test_rows_of_one_id_are_judged_each(spark, make_docs):
    docs = make_docs([(1, "aaa"), (2, "aaa"), (2, "bbb"), (3, "b b b"), (4, "c"), (4, "c"), (4, "c c"), (None, "d"), (None, "e"), (None, "d")])
    got = sorted((r.doc_id or 0, r.text) for r in keep_exact(docs).collect())
    assert got == [(0, "d"), (0, "e"), (1, "aaa"), (3, "b b b"), (4, "c"), (4, "c c")]


def test_index_over_batches(spark, make_docs):
    index = DigestIndex(spark)
    index.append(make_docs([(5, "one"), (6, "two")]))
    index.compact()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(make_docs([(1, "one"), (7, "three")]), index=index).collect()}
    assert got == {1: (1, 2, True), 7: (7, 1, True)}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(make_docs([(8, "t w o"), (9, "one")]), index=index).collect()}
    assert got == {8: (8, 2, True), 9: (1, 3, False)}
    assert index.lookup(index.entries().where("doc_id = 7").select("digest")).first().keep_id == 7
    index.append(make_docs([(0, "three")]))
    assert index.lookup(index.entries().where("doc_id = 7").select("digest")).first().keep_id == 0
    assert index.lookup(index.entries().select("digest").limit(0)).count() == 0

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality as Q


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.score(docs, Q.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in test) / len(test) >= 0.97
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc >= 0.98 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def plain_features(text):
    """The features of one text, a byte and a word at a time."""
    data, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    kinds = list(Q.CLASSES.values())
    out = [sum(b in c for b in data) / max(len(data), 1) for c in kinds]
    pairs = zip(words[1:], words, strict=False)
    upper = [w for w in words if len(w) > 1 and w[0] in Q.CLASSES["upper"] and w[1] in Q.CLASSES["upper"]]
    counts = [sum(a == b for a, b in pairs), sum(len(w) == 1 for w in words), len(upper), sum(w[-1] in Q.CLASSES["sign"] for w in words), sum(w[-1:] == b"!" for w in words), sum(len(w) > 24 for w in words)]
    n = len(words)
    out += [c / max(n, 1) for c in counts] + [sum(map(len, words)) / max(n, 1) / 10]
    return out + [math.log1p(n / (1 + data.count(b"\n"))) / 5, math.log1p(n) / 10, float(n == 0)]


def test_scores_equal_brute_force(spark, sf, texts):
    """Every document of the table, scored by the trained weights over features counted in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))
        z = (np.array(plain_features(t)) - model.centre) / model.scale * (words / (words + Q.DOUBT))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-500, min(500, z @ model.weights - model.threshold))))) < 1e-6


def test_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "A !! B !!"), (3, "A !! B !!"), (None, "some words here"), (5, "x" * 50_000)]).withColumn("_id", F.lit(3)).withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.score(docs, Q.train(docs, none)).collect()
    assert len(rows) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    one = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, None, 0), (3, 0, 1), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, one)
    assert len(Q.score(docs, model).collect()) == 6
    kept = Q.score(docs, model, keep=True)
    assert kept.columns == docs.columns
    assert Q.score(make_docs([]), model).count() == 0 and Q.train(make_docs([]), one) is None


def labelled(spark, docs, labels):
    """Features and labels of every row that may be learned from, by plain Python."""
    mark = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = [r for r in docs.collect() if r.doc_id in mark and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    return Q.features(pa.array([r.text or "" for r in rows])), np.array([mark[r.doc_id] for r in rows])


def test_learns_from_every_labelled_row(spark, make_docs):
    """More rows of each label than 3,000, which were read at most before."""
    docs = make_docs([(i, f"word{i % 7} and {'more !! ' * (i % 5)}") for i in range(11_000)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    x, y = labelled(spark, docs, labels)
    model = Q.train(docs, labels)
    assert min(np.bincount(y)) > 3000 and np.abs(model.centre - x.mean(axis=0)).max() < 1e-8


def test_weights_and_threshold_are_of_all_pairs_and_rows(spark, sf):
    """The gradient of the loss over all pairs vanishes at the weights; no threshold has a smaller sum of error rates."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x, y = labelled(spark, docs, labels)
    model = Q.train(docs, labels)
    z = Q.standard(x, model.centre, model.scale)
    s = z @ model.weights
    good, bad = y == 1, y == 0
    p = 1 / (1 + np.exp(s[good][:, None] - s[bad][None, :]))
    grad = (p.sum(axis=0) @ z[bad] - p.sum(axis=1) @ z[good]) / p.size + 1e-3 * model.weights
    assert np.abs(grad).max() < 4e-6
    wrong = [(s[good] < t).mean() + (s[bad] >= t).mean() for t in [*np.unique(s), np.inf]]
    assert (s[good] < model.threshold).mean() + (s[bad] >= model.threshold).mean() <= min(wrong) + 1 / min(good.sum(), bad.sum())

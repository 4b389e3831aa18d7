import re
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common, quality, secret_scan
from tests.llm.test_near_dedup import groups


def test_stages_take_effect(spark, sf):
    docs = common.documents(spark, sf)
    every = {r.doc_id: r for r in docs.collect()}
    kept, names = docs, docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.written(stage(spark, kept, sf), "stage")
        out[name] = kept.collect()
        if name != "best-fit packing":
            assert kept.columns == names
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in out["quality classifier"]} == good
    best = {}
    for i in good:
        key = re.sub(r"[\x20\x09-\x0D]", "", every[i].text)
        best[key] = min(best.get(key, (1, 0)), (-len(every[i].text), i))
    left = {i for _, i in best.values()}
    assert {r.doc_id for r in out["exact dedup"]} == left
    near = groups({i: every[i].text for i in left})
    left = set(near.values())
    assert {r.doc_id for r in out["MinHash near-dedup"]} == left
    clean = {r.doc_id: r.text for r in out["secret scans"]}
    assert set(clean) == left
    for i, t in clean.items():
        want = re.sub(r'(?i)(token = ")[0-9a-f]{40}"', rf"\g<1>{secret_scan.REDACTED}\"".replace('\\"', '"'), every[i].text)
        assert t == want
    assert {r.doc_id for r in out["best-fit packing"]} == left


def sequences_hold(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_equals_brute_force(spark, sf):
    """run() against plain Python: the ranker's documents, one of each group, secrets marked, ids by the library."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]
    docs = common.documents(spark, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    best = {}
    for i, t in texts.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    left = {i: texts[i] for _, i in best.values()}
    left = {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', lambda m: f'{m[1]}{secret_scan.REDACTED}"', left[i]) for i in set(groups(left).values())}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, p] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences_hold(rows)


def test_edges(spark, make_docs, tmp_path):
    """Nulls, repeated rows, long texts, extra columns with clashing names, and an empty table."""
    good = "The committee met on Tuesday to discuss the plan for the new library and its long history in the town. " * 3
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good + "Another sentence follows here."), (None, None), (4, "word " * 60_000), (5, good.replace("library", "museum")), (6, good + ' token = "0f3b6f5c1d2e4a7b8c9d0e1f2a3b4c5d6e7f8091"')]
    extra = make_docs(rows).withColumn("key", F.lit("k")).withColumn("_hit", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("_own_key", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("some", extra), ("none", extra.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        kept, names = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = common.written(f(spark, kept, folder), "edge")
            assert kept.columns == names, stage
        out = corpus_pipeline.run(spark, folder).collect()
        sequences_hold(out)
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in out if r.piece == 0)
        assert ids.count(1) <= 1 and (name == "some") == bool(ids)

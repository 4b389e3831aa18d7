import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import piece_codec as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", "   a", "a", " " * 40 + "x", "x" + " " * 33, "▁▁a ▁", "日本 語", "tab\tx\n\n y", "é" * 50, "\x00a", "e" * 300, "the  the   thing", "😀 😀"]


def check(df, some):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(some)
    for i, t in enumerate(some):
        ids = lib.encode(t or "")
        assert got[i].ids == ids, (t or "")[:60]
        assert got[i].n_pieces == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4")) and got[i].decoded == lib.decode(ids)
        assert got[i].round_trip or "▁" in t


def test_usual_documents(spark, make_docs, texts):
    some = [*texts.values(), *ODD, None]
    check(P.encode(make_docs(some), PATH, full=True), some)


def test_giant_documents_by_the_scan(spark, make_docs, texts):
    some = [*[t for t in texts.values() if 100 < len(t) < 6000][:12], "ab" * 700, "word " * 400, "x" + " " * 200 + "y" * 90]
    check(P.encode(make_docs(some), PATH, giant=60, chunk=64, full=True), some)


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    m = [np.where(rng.random((4, 4)) < 0.5, 0, -np.inf).astype(np.float32) for _ in range(9)]
    want, out = m[0], [m[0]]
    for x in m[1:]:
        want = P.combine(want, x)
        out.append(want)
    assert all((a == b).all() for a, b in zip(P.scan(m), out, strict=True))


def test_empty_and_repeats(spark, make_docs):
    assert P.encode(make_docs([]), PATH).count() == 0
    assert P.encode(make_docs([(1, "ab " * 50), (1, "ab " * 50), (None, "c")]), PATH, giant=60, chunk=64).count() == 3


def test_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "ab " * 50), (2, "c"), (None, None)]).withColumn("key", F.lit("k")).withColumn("ids", F.lit(1)).withColumn("n_pieces", F.lit("n"))
    rows = P.encode(docs, PATH, giant=60, chunk=64).collect()
    assert sorted((r.doc_id or 0, r.round_trip) for r in rows) == [(0, True), (1, True), (2, True)]

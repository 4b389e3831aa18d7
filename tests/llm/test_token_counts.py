import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common as C
from tessera.llm.token_counts import ByteLevelCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "aaaaaaaaaaaaaa", "日本語", "it's 'LL we'll", " " * 5000, "é́ 😀", "\x00\x1c\x85", "x" * 20_000]


def test_counts_equal_the_library(texts):
    lib, own = Tokenizer.from_file(PATH), ByteLevelCounter(PATH)
    for t in [*texts.values(), *ODD]:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:60]


def test_cache_and_edges(spark, make_docs):
    lib = Tokenizer.from_file(PATH)
    some = [(1, "one two"), (2, "one two"), (2, "one two"), (2, "other"), (None, "one two"), (3, None), (4, ""), (5, "word " * 1200)]
    docs = make_docs(some).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(-1))
    cache = C.scratch(spark, "cache")
    for _ in range(2):  # the second time all are hits
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH, cache).collect())
        want = sorted((i or 0, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in some)
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.select("digest").distinct().count() == 4
    n = stored.count()
    count_tokens(make_docs([(9, "brand new"), (10, "one two")]), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    assert count_tokens(make_docs([]), PATH, cache).count() == 0

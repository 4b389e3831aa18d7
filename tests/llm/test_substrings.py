import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm.substring_dedup import WindowIndex, remove_repeats


def brute(docs, width):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in docs.items()}
    seen = {}
    for k, w in words.items():
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((k, i))
    gone = {k: set() for k in docs}
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + width))
    return {k: (len(w), len(gone[k]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[k]).encode()).hexdigest()) for k, w in words.items()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    passages = [[word() + str(rng.randint(0, 40)) for _ in range(rng.randint(6, 30))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = [word() + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            w[rng.randint(0, len(w)) : 0] = p[a:]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return [*out, out[3], out[3], "x " * 40, None, "", "é ü " * 15, "short"]


def test_against_brute_force(spark, make_docs):
    for width in (9, 12):
        texts = corpus(width)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(make_docs(texts).withColumn("key", F.lit(1)).withColumn("marks", F.lit("m")), width).collect()}
        assert got == brute(dict(enumerate(texts)), width)


def test_batches_and_compaction(spark, make_docs):
    texts = list(enumerate(corpus(7)))
    index = WindowIndex(spark, width=10, gram=5)
    index.append(make_docs(texts[:30]))
    index.append(make_docs(texts[30:50]))
    index.merge()
    last = index.append(make_docs(texts[50:]))
    want = brute(dict(texts), 10)
    for batch, part in ((last, texts[50:]), (0, texts[:30])):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.removed(batch, with_text=True).collect()}
        assert got == {i: want[i] for i, _ in part}


def test_repeated_rows_and_empty(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(50))
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(make_docs([(1, long), (1, long), (None, "a b"), (2, "c")])).collect())
    assert got == [(-1, 0), (1, 50), (1, 50), (2, 0)]
    assert remove_repeats(make_docs([])).count() == 0


def test_long_texts_and_clashing_columns(spark, make_docs):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(60_000)]
    texts = [" ".join(words), "x " + " ".join(words[30_000:30_100]), "y" * 300_000, "z " * 40_000]
    docs = make_docs(texts).withColumn("rep", F.lit(1)).withColumn("at", F.lit(2)).withColumn("window", F.lit("w"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == brute(dict(enumerate(texts)), 35)

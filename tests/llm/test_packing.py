import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.packing import pack, plan
from tessera.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's we'll ''s I'M x're 12 345a <|endoftext|> a", "Ünïcode ΣΑΣ İ ﬁ é café", "a\x01b c\x01", "!'s 's'd 'll'", "\x1c x\x85y", "日本語テキスト 123", "'re", "'", "x" * 3000]


def test_ids_equal_the_library(texts):
    lib, own = Tokenizer.from_file(PATH), WordBpe(PATH)
    some = [*texts.values(), *ODD]
    for t, ids in zip(some, own.encode_batch(some), strict=True):
        assert lib.encode(t, add_special_tokens=False).ids == ids.tolist(), t[:60]


def check(rows, capacity):
    bins = {}
    for r in rows:
        assert 0 < r.length <= capacity
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_whole_documents(spark, make_docs, texts):
    lib = Tokenizer.from_file(PATH)
    some = [*list(texts.values())[:60], None, "", "word " * 5000, "same text", "same text"]
    got = pack(make_docs(some), PATH).collect()
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(some)}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(want)
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.length) == (k, at, min(2048, len(ids) - at))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4"))
            at += r.length
        assert at == len(ids)
    n = check(got, 2048)
    assert n <= 1 + -(-sum(map(len, want.values())) // 2048) * 1.1
    assert pack(make_docs([]), PATH).count() == 0
    assert check(pack(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect(), 2048) == 1


def test_plan_places_every_item_once():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 64, 2048])
        counts = {s: rng.randint(1, 300) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(40, capacity)))}
        ranges, bins = plan(counts, capacity)
        used, seen = [0] * bins, {}
        spans = sorted((o, b, s, n, f) for s, f, n, b, o in ranges)
        for offset, first, size, n, item in spans:
            for k in range(n):
                assert used[first + k] == offset
                used[first + k] += size
            seen.setdefault(size, set()).update(range(item, item + n))
        assert max(used) <= capacity and min(used) > 0
        assert {s: set(range(n)) for s, n in counts.items()} == seen
        total = sum(s * n for s, n in counts.items())
        assert bins <= -(-total // capacity) * 1.7 + 1


def test_large_items_match_at_most_twice_and_best():
    assert plan({1000: 4, 1048: 4}, 2048)[1] == 4
    assert plan({1400: 3, 700: 3, 648: 3}, 2048)[1] == 6 - 1


def test_ids_equal_the_library_for_every_code_point():
    """Also those that the library's Unicode tables know and Python's do not."""
    own, lib = WordBpe(PATH), Tokenizer.from_file(PATH)
    every = [f"x{chr(c)}y {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000] + ["ab Ᲊ cd Ɤᲊx"]
    for i in range(0, len(every), 100_000):
        part = every[i : i + 100_000]
        assert [x.tolist() for x in own.encode_batch(part)] == [x.ids for x in lib.encode_batch(part, add_special_tokens=False)]


def test_clashing_columns_nulls_and_repeats(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, None), (2, "")]).withColumn("piece", F.lit("p")).withColumn("length", F.lit(9)).withColumn("offset", F.lit("o")).withColumn("_salt", F.lit(1))
    got = pack(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3), (2, 1)] and check(got, 2048) == 1
    assert pack(docs.limit(0), PATH).count() == 0

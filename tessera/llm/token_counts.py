"""Token counts through a digest cache.

Documents are keyed by the digest of their content and the digest of the tokenizer's definition. Keys join the
stored counts; only one text of each missing digest is encoded; the new counts are appended to the cache.

Normalisation: a null text counts as empty and nothing else is changed, since a byte-level vocabulary counts every
byte. The vocabulary file of the ``tokenizers`` library is read; encoding runs the same merges through ``tiktoken``,
which is several times faster and gives equal counts (tests compare the two); a text that it refuses goes through
``tokenizers`` itself. A special string inside a text is one token, that library's default.

A row whose text is known already is kept from the encoder by an id filter of bounded size and a join of the rows that
the filter cannot rule out; other texts are not moved.

Defined results. One row per input row, repeated rows included. An empty text has 0 tokens. Further columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Pre-tokenizer of byte-level vocabularies (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the way it is applied."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"count/1\0" + f.read()).hexdigest()


class ByteLevelCounter:
    """Counts tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.path = spec["pre_tokenizer"], path
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.slow = list(special), None

    def count(self, text: str) -> int:
        try:
            if any(s in text for s in self.special):
                return len(self.encoding.encode(text, allowed_special="all"))
            return len(self.encoding.encode_ordinary(text))
        except BaseException as e:  # the regex engine gives up on some giant runs, and says so by a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.path)
            return len(self.slow.encode(text, add_special_tokens=False).ids)


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ByteLevelCounter(path)
        for b in batches:
            counts = [counter.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), b.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. ``tokenizer``: path of the file; ``cache``: path of the
    Parquet cache, which is created and appended to (default: a new one)."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    cache = cache or C.scratch(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    C.small_batches(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = C.written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    first = C.written(keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "token-digests")
    known = first.join(stored.select("digest").distinct(), "digest", "left_semi")
    # rows that need no encoding: of stored digests all, of the others all but the row of the smallest id
    again = keys.join(first.where("n > 1"), "digest").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "digest")
    skip = again.unionByName(keys.join(known.select("digest"), "digest", "left_semi").select("doc_id", "digest"))
    misses = C.without(keyed, skip.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_k"), F.lit(False).alias("_once")), "doc_id", F.col("digest"))
    misses.select("digest", "text").mapInArrow(_encode(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    # an id repeated with the same text, or null ids, can bring a digest twice
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = C.written(counts, "token-counts")  # written, so that the join of a hot digest can be split
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

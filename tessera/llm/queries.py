"""Queries opN_<name> over the whole tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import license_scan, piece_codec, secret_scan
from .ann import nearest
from .exact_dedup import exact_groups
from .near_dedup import near_groups
from .packing import pack
from .quality import score, train
from .substring_dedup import remove_repeats
from .token_counts import count_tokens


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def source_path() -> Column:
    """documents has no paths: its source is taken as the folder, the id as the file's name."""
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score; the finding itself is given as a digest."""
    found = secret_scan.scan(C.documents(spark, sf_dir), path=source_path())
    return found.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.sha2("candidate", 256).alias("finding_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", source_path().alias("path"), "text")
    return license_scan.scan(docs, id_col="doc_id").drop("path")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(C.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(C.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest": """
            WITH v AS (
              SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
            ), r AS (
              SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op4_exact_dedup": r"""
            WITH d AS (
              SELECT doc_id, length(coalesce(text, '')) AS n,
                     sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
              FROM documents
            ), g AS (
              SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
        "op8_substring_dedup": r"""
            WITH w AS (
              SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
              FROM documents
            ), s AS (
              SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
            ), h AS (
              SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM s
            ), r AS (
              SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone
              FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1 GROUP BY doc_id
            ), k AS (
              SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)
            ), kept AS (
              SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
                     list_filter(words, lambda x, j: NOT list_contains(gone, j)) AS left_words
              FROM k
            )
            SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept""",
    }

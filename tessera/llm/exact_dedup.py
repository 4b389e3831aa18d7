"""Exact deduplication over a log-structured merge index of content digests, in DataFrame functions only.

Each task that scans documents is a memtable: it flushes its (digest, id, length) entries as one sorted run, a Parquet
file with a bloom filter and min/max statistics on the digest. The files of one append are dealt to ``RUNS`` runs;
compaction merges one run after the other into level 1, which holds for each digest the entry that stays, and reads
only level 1 and the new runs. ``lookup`` probes the filters and the statistics. Groups of two or more rows (hits) are
read again and compared byte by byte with the row that stays, so a digest collision cannot merge different texts.

Defined results. Null text counts as empty. Of equal normalised texts the row with most code points in the
original text stays, then the smallest doc_id (null ids last). Rows that repeat both id and text are one document:
all are reported, each with kept = true if its id stays, and ``keep_exact`` lets only one of them through, as it lets
one row of each group through where rows of different texts share an id. An empty table gives an empty result.
Further columns, whatever their names, are ignored by the index and kept by ``keep_exact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "262144"}
ENTRY = "digest binary, doc_id long, n_points int"
LEVEL = "digest binary, keep_points int, keep_id long, group_size long"
#: Runs that the files of one append are dealt to, and digests that one lookup probes at most by the runs' filters.
RUNS, PROBES = 3, 1000


def normalised(text: str | Column = "text") -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank)), C.BLANKS, C.text_or_empty(text))


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


class DigestIndex:
    """Runs and their compaction under ``path``: append(batch) as batches arrive, compact() now and then.

    path/batch=N/run=M holds level-0 runs of entries (digest, doc_id, n_points), path/level1=N the compacted rows
    (digest, keep_points, keep_id, group_size). Entries stay readable after compaction, for the rows of a group, and
    so must the documents of all batches, for verification."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.n = spark, path or C.scratch(spark, "digest-index"), 0
        self.runs: list[str] = []
        self.pending: list[str] = []
        self.batches: list[tuple[DataFrame, list[str]]] = []
        self.level1: str | None = None

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush one batch: every scanning task writes one sorted file, the files are dealt to runs."""
        out = f"{self.path}/batch={self.n}"
        entries = docs.select(
            digest_of(normalised(text_col)).alias("digest"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.length(C.text_or_empty(text_col)).alias("n_points"),
            F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
        )
        entries.sortWithinPartitions("run", "digest").write.options(**RUN_OPTIONS).partitionBy("run").parquet(out)
        found = [r.run for r in self.spark.read.schema(ENTRY + ", run int").parquet(out).select("run").distinct().collect()]  # at most RUNS
        new = [f"{out}/run={r}" for r in sorted(found)]
        self.runs += new
        self.pending += new
        self.batches.append((docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), new))
        self.n += 1

    def entries(self, last: bool = False) -> DataFrame:
        """All entries ever appended, or those of the last batch."""
        runs = self.batches[-1][1] if last else self.runs
        return self.spark.read.schema(ENTRY).parquet(*runs) if runs else self.spark.createDataFrame([], ENTRY)

    def texts(self) -> DataFrame:
        """doc_id, text of all batches."""
        return reduce(DataFrame.unionByName, [docs for docs, _ in self.batches])

    def level(self) -> DataFrame:
        """The compacted rows."""
        return self.spark.read.schema(LEVEL).parquet(self.level1) if self.level1 else self.spark.createDataFrame([], LEVEL)

    def compact(self) -> DataFrame:
        """Merge the pending runs, one after the other, into level 1. Partial aggregation runs before the shuffle, so
        a digest that holds a third of the rows costs one row per task."""
        best = F.min(F.struct((-F.col("keep_points")).alias("p"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("i")))
        while self.pending:
            run = self.spark.read.schema(ENTRY).parquet(self.pending[0])
            new = run.select("digest", F.col("n_points").alias("keep_points"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
            merged = self.level().unionByName(new).groupBy("digest").agg(best.alias("k"), F.sum("group_size").alias("group_size"))
            kept = merged.select("digest", (-F.col("k.p")).cast("int").alias("keep_points"), F.col("k.i").alias("keep_id"), "group_size")
            out, old = f"{self.path}/level1={self.n}", self.level() if self.level1 else None
            kept.sortWithinPartitions("digest").write.options(**RUN_OPTIONS).parquet(out)
            self.level1, self.n = out, self.n + 1
            self.pending.pop(0)
            if old:
                C.removed(old)
        return self.level()

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The index rows of ``digests`` (column digest), all runs included. Up to PROBES digests are pushed to the
        files, whose statistics and bloom filters rule out row groups; more are joined."""
        level = self.compact()
        some = [bytes(r.digest) for r in digests.select("digest").distinct().limit(PROBES + 1).collect()]  # bounded
        if len(some) <= PROBES:
            return level.where(F.col("digest").isin(some)) if some else level.limit(0)
        return digests.select("digest").distinct().join(level, "digest")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Appends docs to the index and gives digest, doc_id, n_points, keep_points, keep_id, group_size of each of its
    rows, judged against all batches and verified byte by byte."""
    index = index or DigestIndex(docs.sparkSession)
    index.append(docs, id_col, text_col)
    level, entries = index.compact(), index.entries(last=True)
    resolved = entries.join(level, "digest")
    # groups of several rows that this batch has rows of; one row a digest and task before the shuffle
    touched = level.where("group_size > 1")
    if len(index.batches) > 1:
        touched = touched.join(entries.select("digest").distinct(), "digest", "left_semi")
    touched = C.written(touched, "touched")
    if not touched.limit(1).count():
        return resolved
    hits = C.written(index.entries().join(touched.select("digest"), "digest").select("doc_id"), "hits")

    def norm(ids: DataFrame, column: str) -> DataFrame:
        some = C.IdFilter(ids, column).marked(index.texts(), F.col("doc_id"), "_hit").where("_hit")
        return some.select("doc_id", F.length(C.text_or_empty("text")).alias("n_points"), normalised("text").alias("norm")).withColumn("digest", digest_of(F.col("norm")))

    # the texts of rows that stay, and byte verification of every hit against them: joins of exchanged sides, which
    # adaptive execution can split where a digest is hot; rows that differ would be digest collisions
    keep = touched.select(F.col("digest").alias("_d"), "keep_id", "keep_points")
    own = norm(touched, "keep_id")
    own = own.join(keep, (own.digest == F.col("_d")) & own.doc_id.eqNullSafe(F.col("keep_id")) & (own.n_points == F.col("keep_points")))
    own = C.written(own.groupBy("_d").agg(F.min("norm").alias("keep_norm")), "kept-texts")
    differ = C.written(norm(hits, "doc_id").join(own, F.col("digest") == F.col("_d")).where("norm != keep_norm").select("_d", F.col("doc_id").alias("_i")), "differ")
    C.removed(own, hits, touched)
    if not differ.limit(1).count():
        return resolved
    alone = differ.distinct().withColumn("_alone", F.lit(True))
    resolved = resolved.join(alone, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left")
    return resolved.withColumns({"keep_id": F.expr("if(_alone, doc_id, keep_id)"), "keep_points": F.expr("if(_alone, n_points, keep_points)"), "group_size": F.expr("if(_alone, 1L, group_size)")}).drop("_d", "_i", "_alone")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, which join the index and are judged
    against all its batches."""
    return resolve(docs, id_col, text_col, index).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns unchanged. Rows are told apart by id, digest and
    length; of rows equal in all three one stays."""
    found = C.written(resolve(docs, id_col, text_col).where("group_size > 1"), "exact-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    rows = found.groupBy(F.col("doc_id").alias("_i"), "digest", "n_points").agg(F.count(F.lit(1)).alias("c"), F.bool_or(stays).alias("_once"))
    gone = rows.where("c > 1 or not _once").select("_i", F.struct("digest", "n_points").alias("_k"), "_once")
    return C.without(docs, gone, id_col, F.struct(digest_of(normalised(text_col)).alias("digest"), F.length(C.text_or_empty(text_col)).alias("n_points")))

"""Removal of passages that repeat across a corpus, over a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Each window is represented by the smallest hash among its grams of ``gram``
words (leftmost of equals), so equal windows have the same representative at the same place. Consecutive windows with
one representative form a block. The fingerprints of appended documents (representative, digest of the block's words)
are sorted, immutable runs. Level 1 holds the representatives of all merged runs with their counts, sorted; a new run
is merged into it by one aggregation, which also tells the run's representatives that occur elsewhere. Only their
blocks, of this and of earlier runs, are judged:

1. Representatives that occur once leave at once: none of their windows can repeat. A filter of bounded size keeps
   most of their blocks out of every shuffle.
2. A block whose words (128-bit digest) occur twice repeats as a whole: all its windows are marked, none is emitted.
3. Of the rest, every window is emitted with a digest of its words; so are the windows of one copy of each block that
   repeats beside them. Windows with equal digests repeat.
4. Words under marked windows go.

The digests cover the words themselves (BLAKE2b, 16 bytes), which verifies what the fingerprints suggest. No bucket
is capped and no group of copies is expanded into pairs. Marks of earlier batches grow as later ones repeat them.

Defined results. Null text has no words. Rows that repeat both id and text count as two documents, so each repeats
the other; rows are told apart by 128 bits of id and text. Texts of fewer than ``width`` words lose nothing, texts of
any length are read whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling as R

WIDTH, GRAM = 35, 8
RUN = "rep long, block binary, key binary, at int, n int"
LEVEL, MARKS = "rep long, c long", "key binary, at int, n int"
#: Runs that the files of one append are dealt to.
RUNS = 3


def _gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` word hashes."""
    n = len(h) - gram + 1
    total = np.zeros(n, np.uint64)
    for j in range(gram):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return R.mix(total)


def _sliding_argmin(g: np.ndarray, span: int) -> np.ndarray:
    """For each start of ``span`` values, where the leftmost least value is."""
    n, size = len(g) - span + 1, 1
    best, at = g, np.arange(len(g))
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        size += step
    return at[:n]


def blocks_of(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's word hashes: representative, first window and number of windows of each block."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _gram_hashes(h, gram)
    at = _sliding_argmin(g, width - gram + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return g[at[first]].view(np.int64), first, np.diff(np.r_[first, len(at)])


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class _Words:
    """Words of one text as slices of the text with single spaces."""

    def __init__(self, text: bytes):
        parts = text.split()
        self.data, self.parts = b" ".join(parts), parts
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.end = np.cumsum(sizes) - 1
        self.start = self.end - sizes + 1

    def piece(self, a: int, b: int) -> bytes:
        return self.data[self.start[a] : self.end[b - 1]]


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(b.column("text").cast(pa.large_binary())):
        yield i, t.as_py() or b""


def _fingerprint(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key")
            for first, end, data, offsets in R.blocks(b.column("text"), R.CHUNK):
                row, s, e, h = R.row_words(data, offsets)
                at = np.searchsorted(row, np.arange(end - first + 1))
                out: list[list] = [[], [], [], [], []]
                for i in range(end - first):
                    a, z = at[i], at[i + 1]
                    if z - a < width:
                        continue
                    rep, start, n = blocks_of(h[a:z], width, gram)
                    w = _Words(data[offsets[i] : offsets[i + 1]].tobytes())
                    lo, hi = w.start[start], w.end[start + n - 1 + width - 1]
                    out[0].append(rep)
                    out[1] += [_digest(w.data[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    out[2].append(pa.array([keys[first + i].as_py()] * len(rep), pa.binary()))
                    out[3].append(start)
                    out[4].append(n)
                if out[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(out[1], pa.binary()), pa.concat_arrays(out[2]), pa.array(np.concatenate(out[3]), pa.int32()), pa.array(np.concatenate(out[4]), pa.int32())], ["rep", "block", "key", "at", "n"])

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ranges = b.column("key"), b.column("ranges")
            for i, text in _texts(b):
                w = _Words(text)
                starts = np.unique(np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in ranges[i].as_py()]))
                lo, hi = w.start[starts].tolist(), w.end[starts + width - 1].tolist()
                digests = [_digest(w.data[x:y]) for x, y in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([keys[i].as_py()] * len(starts), pa.binary()), pa.array(starts, pa.int32())], ["window", "key", "at"])

    return run


def _remove(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column("marks")
            out: list[list] = [[], [], [], []]
            for i, text in _texts(b):
                words, gone = text.split(), 0
                ranges = marks[i].as_py()
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    lo = np.array([r["at"] for r in ranges])
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + np.array([r["n"] for r in ranges]) + width - 1, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    words_left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    words_left = words
                kept = b" ".join(words_left)
                for column, value in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            cols = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(out[3], pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


class WindowIndex:
    """Append batches of documents; ``merge()`` judges their runs against all merged ones and compacts; ``removed()``
    gives the documents without repeated words, judged against all batches. The documents must stay readable."""

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, gram: int = GRAM):
        self.spark, self.path, self.width, self.gram = spark, path or C.scratch(spark, "window-index"), width, gram
        self.runs: list[str] = []
        self.pending: list[str] = []
        self.marks_at: list[str] = []
        self.level1: str | None = None
        self.batches: list[DataFrame] = []
        self.n = 0

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 1) -> int:
        """Write the batch's runs: each scanning task writes one sorted file, the files are dealt to runs. The batch's
        number is returned."""
        C.small_batches(self.spark)
        rows = docs.select(F.col(id_col).alias("doc_id"), C.text_or_empty(text_col).alias("text")).withColumn("key", C.row_key("doc_id", "text"))
        out = f"{self.path}/batch={len(self.batches)}"
        found = rows.select("key", "text").mapInArrow(_fingerprint(self.width, self.gram), RUN)
        found = found.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))).sortWithinPartitions("run", "rep")
        found.write.partitionBy("run").parquet(out)
        some = self.spark.read.schema(RUN + ", run int").parquet(out).select("run").distinct().collect()  # at most ``runs``
        self.pending += [f"{out}/run={r.run}" for r in sorted(some)]
        self.batches.append(rows)
        return len(self.batches) - 1

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self) -> None:
        """Merge the pending runs into level 1, one after the other, and mark what repeats through them."""
        while self.pending:
            path = self.pending.pop(0)
            new = self._read(RUN, [path]).groupBy("rep").agg(F.count(F.lit(1)).alias("c"))
            old = self._read(LEVEL, [self.level1] if self.level1 else [])
            both = old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
            both = both.groupBy("rep").agg(F.sum("c").alias("c"), F.bool_or("new").alias("new"))
            out = f"{self.path}/level1={self.n}"
            both.sortWithinPartitions("rep").write.parquet(out)
            if self.level1:
                C.removed(old)
            self.level1, self.n = out, self.n + 1
            self.runs.append(path)
            touched = self._read(LEVEL + ", new boolean", [out]).where("new and c > 1").select("rep")
            marks = f"{self.path}/marks={self.n}"
            self._judge(touched).write.parquet(marks)
            self.marks_at.append(marks)

    def _judge(self, reps: DataFrame) -> DataFrame:
        """key, at, n: windows that repeat, of the representatives in ``reps`` (a written table)."""
        shared = C.written(C.semi(self._read(RUN, self.runs), reps, "rep"), "shared-blocks")
        blocks = C.written(shared.groupBy("rep", "block").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at", "n")).alias("one")), "blocks")
        whole = shared.join(blocks.where("copies > 1").select("rep", "block"), ["rep", "block"], "left_semi").select("key", "at", "n")
        # blocks that occur once beside others of their representative, and one copy of each repeated block beside them
        alone = F.sum(F.when(F.col("copies") == 1, 1).otherwise(0))
        mixed = C.written(blocks.groupBy("rep").agg(F.count(F.lit(1)).alias("kinds"), alone.alias("alone")).where("kinds > 1 and alone > 0").select("rep"), "mixed-reps")
        work = blocks.join(mixed, "rep").select("one.*").groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
        work = C.written(work, "open-blocks")
        texts = C.semi(self.texts(), work, "key").select("key", "text", "ranges")
        windows = C.written(texts.mapInArrow(_windows(self.width), "window binary, key binary, at int"), "windows")
        twice = C.written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("window"), "repeated-windows")
        found = C.semi(windows, twice, "window").select("key", "at", F.lit(1).alias("n"))
        return whole.unionByName(found)

    def texts(self) -> DataFrame:
        """key, text of all batches; rows that repeat come as often as they are."""
        return reduce(DataFrame.unionByName, [rows.select("key", "text") for rows in self.batches])

    def marks(self) -> DataFrame:
        """key, at, n: runs of windows that occur elsewhere too."""
        self.merge()
        return self._read(MARKS, self.marks_at)

    def removed(self, batch: int = 0, with_text: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each document of a batch. Texts without a mark
        are not moved."""
        marks = C.written(self.marks().groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("marks")), "marks")
        maybe, sure = C.dealt(self.batches[batch], C.IdFilter(marks, "key"), F.col("key"))
        none = F.lit(None).cast(marks.schema["marks"].dataType)
        rows = maybe.join(marks, "key", "left").select("doc_id", "text", "marks").unionByName(sure.select("doc_id", "text", none.alias("marks")))
        kind = self.batches[batch].schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_remove(self.width, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    index = WindowIndex(docs.sparkSession, width=width, gram=min(GRAM, width))
    return index.removed(index.append(docs, id_col, text_col, RUNS), with_text)

"""Best-fit packing of tokenized documents into sequences of a fixed length.

Only documents longer than the capacity are cut. The packing is planned on the histogram of piece lengths, which has
at most ``capacity`` entries whatever the size of the corpus:

* large items, above a third of the capacity, share a bin at most in twos: the largest is matched with the largest
  that still fits, until none is left to match;
* smaller items, largest first, go into the smallest remaining gap that takes them (best fit), else into new bins.

Equal lengths are interchangeable, so the plan is a list of ranges: items number r..r+n of length l go to bins
b..b+n at one offset. Items get their number by a count over (length, salt) and offsets of the salts, so that a
length which a third of the corpus shares is numbered by many tasks. The plan has at most one range for each pair of
length and gap class.

Defined results. A null text is empty; its document is the end id alone. One set of pieces per input row. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that one task numbers, about.
ROWS_PER_SALT = 20_000


def _cut(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import slices
        from .word_bpe import encoder_of

        encoder = encoder_of(tokenizer)
        for b in (part for whole in batches for part in slices(whole)):
            rows: list[tuple] = []
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for doc, ids in zip(docs, encoder.encode_batch(texts), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, p, at, len(part), zlib.crc32(part), part.tobytes() if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=False)], [n for n, _ in kinds])

    return run


class _Gaps:
    """Bins by the room left in them: ranges of bin numbers for each gap."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.ranges:
                self.ranges[gap] = []
                insort(self.sizes, gap)
            self.ranges[gap].append((first, n))

    def take(self, least: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` bins of the smallest gap of at least ``least``: gap, first bin, how many."""
        i = bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, n = self.ranges[gap].pop()
        if n > most:
            self.ranges[gap].append((first + most, n - most))
            n = most
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[i]
        return gap, first, n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first item, items, first bin, offset) and the number of bins."""
    left = {s: n for s, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    ranges: list[tuple[int, int, int, int, int]] = []
    gaps, bins = _Gaps(), 0

    def place(size: int, n: int, first: int, offset: int) -> None:
        ranges.append((size, done[size], n, first, offset))
        done[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        i = bisect_left(large, capacity - size + 1) - 1
        while i >= 0 and (not left[large[i]] or (large[i] == size and left[size] < 2)):
            i -= 1
        if i < 0:  # nothing fits beside it: alone
            n = left[size]
            place(size, n, bins, 0)
            gaps.put(capacity - size, bins, n)
        else:
            mate = large[i]
            n = left[size] // 2 if mate == size else min(left[size], left[mate])
            place(size, n, bins, 0)
            place(mate, n, bins, size)
            gaps.put(capacity - size - mate, bins, n)
        bins += n
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            found = gaps.take(size, left[size])
            if found:
                gap, first, n = found
                place(size, n, first, capacity - gap)
                gaps.put(gap - size, first, n)
                continue
            each = capacity // size
            n = left[size] // each or 1
            each = min(each, left[size])
            for k in range(each):
                place(size, n, bins, k * size)
            gaps.put(capacity - each * size, bins, n)
            bins += n
    return ranges, bins


def _assign(ranges: list[tuple[int, int, int, int, int]]):
    size, first, _, bin_, offset = (np.array(x, np.int64) for x in zip(*sorted(ranges), strict=True))
    key = (size << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            i = np.searchsorted(key, (length << 44) + number, "right") - 1
            cols = [c for c in b.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(bin_[i] + number - first[i]), pa.array(offset[i])], [*cols, "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The token pieces of every document; with ids, those as little-endian unsigned 32-bit numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
    C.small_batches(docs.sparkSession)
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    cut = C.written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long"
    if not counts:
        return docs.sparkSession.createDataFrame([], schema)
    salts = max(8, math.ceil(max(counts.values()) / ROWS_PER_SALT))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranges, _ = plan(counts, capacity)
    numbered = salted.withColumn("_in", number).join(before, ["length", "_salt"])
    columns = [c for c in cut.columns if c != "offset"]
    return numbered.select(*columns, (F.col("_before") + F.col("_in")).cast("long").alias("_number")).mapInArrow(_assign(ranges), schema)

"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to unit length, padded with zeros to B >= 256 coordinates, turned by one random rotation and
reduced to the signs of its coordinates. The index keeps the packed signs, the length, the correction scalar
c = <signs / sqrt(B), turned vector> and the vector itself (in its own width), in blocks. For a query q the inner product is estimated as
|o| <signs / sqrt(B), Rq> / c, and it lies within |o| |q| sqrt(1 - c^2) / c * ``deviations`` / sqrt(B - 1) of that,
except with the chance of a normal value beyond so many deviations. Vectors whose upper bound reaches the best k
exact scores seen so far are reranked in double precision.

Queries meet candidates in a grid of bounded cells (an equi-join on the cell), and only k rows per query and cell
leave a cell. Nothing is broadcast.

Defined results. Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors
of another dimension than ``dim`` (default: the most common one, the smaller of equals). A query never meets rows of
its own id. Rows that repeat an id are candidates each; as queries, the usable vector that compares smallest is asked.
Ties go to the smaller id. Null ids take no part. Further columns are ignored. No rows, no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Least bits of a code, and normal deviations of the error bound.
BITS, DEVIATIONS = 256, 4.0
#: Numbers in the vectors of a stored block, and of a cell on either side: the rows of each follow from the dimension.
BLOCK, CELL_ROWS, CELL_QUERIES = 1 << 17, 1 << 21, 1 << 18
BLOCKS = "part long, n int, ids binary, codes binary, norms binary, corrections binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of B coordinates: at least BITS, in whole words of 64."""
    bits = -(-max(dim, BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and correction scalars."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norms[:, None]) @ turn.T
    return np.packbits(turned >= 0, axis=1), norms, np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of a and j of b, summed in the order of the components."""
    out = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(dim: int, seed: int, block: int, kind: type):
    def row(ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
        codes, norms, corrections = encode(vectors.astype(np.float64), turn)
        part = int.from_bytes(np.random.default_rng([len(ids), *ids[:2].view(np.uint64).tolist()]).bytes(6), "little")
        data = [[part], [len(ids)], *([x.tobytes()] for x in (ids, codes, norms, corrections, vectors))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["part", "n", "ids", "codes", "norms", "corrections", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, vectors = rotation(dim, seed), np.zeros(0, np.int64), np.zeros((0, dim), kind)
        for b in batches:
            new = _numbers(b.column("vector"), dim)
            keep = np.isfinite(new).all(axis=1) & (new != 0).any(axis=1)
            ids = np.concatenate([ids, b.column("id").to_numpy(zero_copy_only=False)[keep]])
            vectors = np.concatenate([vectors, new[keep]])
            while len(ids) >= block:
                yield row(ids[:block], vectors[:block], turn)
                ids, vectors = ids[block:], vectors[block:]
        if len(ids):
            yield row(ids, vectors, turn)

    return run


def _unpack(t: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    kinds = {"ids": np.int64, "codes": np.uint8, "norms": np.float64, "corrections": np.float64, "vectors": np.float64}
    if t.num_rows and len(t.column("vectors")[0].as_py()) == 4 * dim * t.column("n")[0].as_py():
        kinds["vectors"] = np.float32
    ids, codes, norms, corr, vectors = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)]) for c, kind in kinds.items())
    return ids, codes.reshape(len(ids), -1), norms, corr, vectors.reshape(-1, dim).astype(np.float64)


def _search(dim: int, seed: int, k: int, deviations: float, step: int = 512):
    def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
        """Positions of the ``keep`` best of each query: score falling, id rising."""
        order = np.lexsort((ids, -score, q))
        q = q[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        return order[place < keep]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            turn = rotation(dim, seed)
            ids, codes, norms, corr, vectors = _unpack(rows, dim)
            q_ids, _, q_norms, _, q_vectors = _unpack(asked, dim)
            # estimates are of queries of length 1, in units of the longest vector, so that 32 bits hold them
            unit = float(2.0 ** np.frexp(norms.max())[1])
            bits, turned, norms = len(turn), ((q_vectors / q_norms[:, None]) @ turn.T).astype(np.float32), norms / unit
            error = (deviations * np.sqrt(np.maximum(0, 1 - corr**2)) / corr / math.sqrt(bits - 1) * norms + 1e-5 * norms).astype(np.float32)
            scale = (norms / corr / math.sqrt(bits)).astype(np.float32)
            for i in range(0, len(q_ids), step):
                s = slice(i, i + step)
                asked_t, size = np.ascontiguousarray(q_vectors[s].T), q_norms[s] * unit
                found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                reach = np.full(len(q_ids[s]), -np.inf)
                for j in range(0, len(ids), 8192):
                    c = slice(j, j + 8192)
                    rows_t = np.ascontiguousarray(vectors[c].T)
                    signs = np.unpackbits(codes[c], axis=1, count=bits).astype(np.float32) * 2 - 1
                    # estimate for each query and candidate from the packed signs and the correction scalar
                    estimate = (turned[s] @ signs.T) * scale[c]
                    both = np.flatnonzero(np.isin(ids[c], q_ids[s]))
                    qi, ci = np.nonzero(q_ids[s, None] == ids[None, c][:, both])
                    estimate[qi, both[ci]] = -np.inf  # a query's own rows
                    if len(ids[c]) > k and np.isneginf(reach).any():  # exact scores of the best estimates set the bar first
                        top = np.argpartition(-estimate, k - 1, axis=1)[:, :k]
                        scores = exact(asked_t, np.arange(len(top)).repeat(k), rows_t, top.ravel()).reshape(-1, k)
                        scores[np.isneginf(np.take_along_axis(estimate, top, 1))] = -np.inf
                        reach = np.maximum(reach, scores.min(axis=1))
                    own = np.isneginf(estimate) if len(both) else None
                    estimate += error[None, c]
                    near = estimate >= (reach / size)[:, None].astype(np.float32) - np.float32(1e-6)
                    if own is not None:
                        near &= ~own
                    qi, ci = np.nonzero(near)
                    score = np.concatenate([exact(asked_t, qi[x : x + 65536], rows_t, ci[x : x + 65536]) for x in range(0, len(qi), 65536)] or [np.zeros(0)])
                    good = score >= reach[qi]
                    qi, ci, score = qi[good], ci[good], score[good]
                    found = [np.concatenate(x) for x in zip(found, (qi, ids[c][ci], score), strict=True)]
                    found = [x[keep] for keep in [best(*found, k)] for x in found]
                    full = np.bincount(found[0], minlength=len(reach)) >= k
                    lowest = np.full(len(reach), np.inf)
                    np.minimum.at(lowest, found[0], found[2])
                    reach = np.where(full, np.maximum(reach, lowest), reach)
                out.append([q_ids[s][found[0]], found[1], found[2]])
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = vectors.schema[vec_col].dataType.simpleString()
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    return whole.where("id is not null and size(vector) > 0 and not exists(vector, x -> x is null)")


def build_index(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, block: int | None = None) -> DataFrame:
    """The index: one row per block of vectors, written in the shared folder."""
    rows = _usable(vectors, id_col, vec_col).where(F.size("vector") == dim)
    kind = np.float32 if rows.schema["vector"].dataType.simpleString() == "array<float>" else np.float64
    return C.written(rows.mapInArrow(_pack(dim, seed, block or max(1, BLOCK // dim), kind), BLOCKS), "one-bit-index")


def common_dim(vectors: DataFrame, id_col: str, vec_col: str) -> int:
    top = _usable(vectors, id_col, vec_col).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top.d if top else 0


def nearest(vectors: DataFrame, queries: Column, k: int = 20, deviations: float = DEVIATIONS, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of every row where ``queries`` holds."""
    spark = vectors.sparkSession
    dim = dim or common_dim(vectors, id_col, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    asked = _usable(vectors.where(queries), id_col, vec_col).where(F.size("vector") == dim)
    asked = asked.where("forall(vector, x -> not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    asked = asked.groupBy(F.col("id").alias("_id")).agg(F.min("vector").alias("_vector"))
    index = build_index(vectors, dim, id_col, vec_col, seed)
    asked = build_index(asked, dim, "_id", "_vector", seed, max(1, CELL_QUERIES // dim // 16))
    n, q = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (index, asked))
    if not n or not q:
        return empty
    rows, probes = max(1, CELL_ROWS // dim), max(1, CELL_QUERIES // dim)
    across, down = math.ceil(n / min(rows, max(rows // 16, n // 16))), math.ceil(q / probes)
    cells = index.withColumn("g", F.pmod("part", F.lit(across))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    queries_in = asked.withColumn("h", F.pmod("part", F.lit(down)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    found = cells.groupBy("g", "h").cogroup(queries_in.groupBy("g", "h")).applyInArrow(_search(dim, seed, k, deviations), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

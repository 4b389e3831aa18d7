"""k nearest neighbours on embedding columns: exact top-k, exact batch join, and an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions import vectors as V
from tessera.scratch import written

#: Rows and queries that meet in one block of a join, about.
BLOCK_ROWS, BLOCK_QUERIES = 10_000, 4_096
#: Numbers in the largest arrays that a block makes.
NUMBERS = 1 << 21


def knn(df: DataFrame, query: list[float], k: int, metric: str = "l2", vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows of one query: ORDER BY distance, id LIMIT k, one heap per task."""
    return df.withColumn("distance", V.vector_distance(F.col(vec), V.literal(query), metric)).where("distance is not null").orderBy("distance", id_col).limit(k)


def _vectors(t: pa.Table, name: str) -> tuple[pa.Table, np.ndarray]:
    """The rows whose vector is there and holds no NULL, and their vectors in double precision."""
    t = t.filter(pc.is_valid(t[name])).combine_chunks()
    flat, dims = pc.list_flatten(t[name]), set(pc.unique(pc.list_value_length(t[name])).to_pylist())
    if len(dims) > 1:
        raise ValueError("vectors of different dimension")
    whole = ~flat.is_null().to_numpy().reshape(t.num_rows, -1).any(axis=1) if flat.null_count else np.ones(t.num_rows, bool)
    numbers = flat.cast(pa.float64()).to_numpy().reshape(t.num_rows, dims.pop() if dims else 0)
    return t.filter(pa.array(whole)), np.ascontiguousarray(numbers[whole])


def _sums(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, added in the order of the components as the expressions of V add them."""
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _cosine(r: np.ndarray, q: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(_sums(r * r)) * np.sqrt(_sums(q * q))
    return 1 - np.where(lengths == 0, 0.0, np.fmax(-1.0, np.fmin(1.0, _sums(r * q) / np.where(lengths == 0, 1.0, lengths))))


#: The distances of V.METRICS for pairs of vectors, equal to the last bit.
EXACT: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": lambda r, q: np.sqrt(_sums((r - q) * (r - q))),
    "cosine": _cosine,
    "ip": lambda r, q: -_sums(r * q),
    "manhattan": lambda r, q: _sums(np.abs(r - q)),
}
NAMES = {"euclidean": "l2", "inner_product": "ip", "l1": "manhattan"}


def _to_centres(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of vectors to centres, by differences: exact enough where both are far from zero."""
    return np.sqrt(np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)) if len(centres) else np.zeros((len(v), 0))


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Marks the first k of each run of equal numbers."""
    places = np.arange(len(groups))
    starts = np.r_[True, groups[1:] != groups[:-1]][: len(groups)]
    return places - np.maximum.accumulate(np.where(starts, places, 0)) < k


def _near(rows: np.ndarray, asked: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that hold the k nearest rows of every query, ties at the k-th distance included.

    Products of matrices give each distance (of l2 its square) up to a bound of their rounding; a pair stays if it may
    be as near as the largest that k rows of the query can have. All pairs stay where there is no such bound."""
    rr, qq = (rows * rows).sum(axis=1), (asked * asked).sum(axis=1)
    sizes = np.concatenate([rr, qq])
    if len(rows) <= k or metric == "manhattan" or not ((sizes == 0) | (sizes > 1e-200) & (sizes < 1e200)).all():
        return np.arange(len(asked)).repeat(len(rows)), np.tile(np.arange(len(rows)), len(asked))
    if metric == "cosine":
        rows, asked = rows / np.sqrt(np.where(rr == 0, 1, rr))[:, None], asked / np.sqrt(np.where(qq == 0, 1, qq))[:, None]
        rr, qq = np.ones_like(rr), np.ones_like(qq)
    slack = (8 * rows.shape[1] + 64) * 2.0**-52
    least = asked @ rows.T
    least *= -2 if metric == "l2" else -1
    least -= slack * qq[:, None]
    least -= slack * rr
    if metric == "l2":
        least += qq[:, None]
        least += rr
    top = np.argpartition(least, k - 1, axis=1)[:, :k]
    reach = (np.take_along_axis(least, top, 1) + 2 * slack * (qq[:, None] + rr[top])).max(axis=1)
    return np.nonzero(least <= reach[:, None])


def _block(k: int, metric: str, id_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of each query of a block, by (distance, id), as query_id, id, distance."""
    metric = NAMES.get(metric.lower(), metric.lower())

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, r = _vectors(rows.take(pc.sort_indices(rows[id_col])), "_v")  # in the order of their ids, NULL last
        asked, q = _vectors(asked, "_q")
        found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]]
        if len(r) and len(q):
            if r.shape[1] != q.shape[1]:
                raise ValueError("vectors of different dimension")
            if len(r) > k and r.shape[1]:  # of equal vectors the k smallest ids are enough
                same = np.unique(r.view(np.dtype((np.void, 8 * r.shape[1]))).ravel(), return_inverse=True)[1].ravel()
                order = np.argsort(same, kind="stable")
                keep = np.sort(order[_first(same[order], k)])
                rows, r = rows.take(pa.array(keep)), r[keep]
            step, part = max(1, NUMBERS // max(len(r), 1)), max(1, NUMBERS // max(r.shape[1], 1))
            for at in range(0, len(q), step):
                qi, ri = _near(r, q[at : at + step], k, metric)
                qi = qi + at
                d = np.concatenate([EXACT[metric](r[ri[i : i + part]], q[qi[i : i + part]]) for i in range(0, len(qi), part)])
                best = np.lexsort((ri, d, qi))
                best = best[_first(qi[best], k)]
                found.append([qi[best], ri[best], d[best]])
        qi, ri, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": asked["query_id"].take(pa.array(qi)), id_col: rows[id_col].take(pa.array(ri)), "distance": pa.array(d)})

    return run


def _meet(rows: DataFrame, asked: DataFrame, cell: list[str], k: int, metric: str, id_col: str) -> DataFrame:
    """query_id, id, distance: the k nearest rows that each query (query_id, _q) meets in every cell of rows (id, _v)."""
    if metric.lower() not in V.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    made = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(id_col, rows.schema[id_col].dataType), StructField("distance", DoubleType())])
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_block(k, metric, id_col), made)


def _dealt(column: str, parts: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _each(parts: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts) - 1))


def knn_join(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2", vec: str = "embedding", id_col: str = "vec_id", blocks: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest rows of every query. ``blocks``: default by the count of rows.

    Queries and rows meet in a grid of blocks; each block keeps k rows per query before they are merged."""
    blocks, batches = blocks or max(4, math.ceil(rows.count() / BLOCK_ROWS)), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("_q"), _dealt(id_col, batches).alias("_c")).withColumn("_b", _each(blocks))
    r = rows.select(F.col(id_col), F.col(vec).alias("_v"), _dealt(id_col, blocks).alias("_b")).withColumn("_c", _each(batches))
    best = _meet(r, q, ["_b", "_c"], k, metric, id_col)
    return best.select("query_id", id_col, "distance", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last(id_col))).cast("bigint").alias("rank")).where(F.col("rank") <= k)


#: Metrics that are never less than the Euclidean distance, for which a cell's radius bounds its rows' distances.
BOUNDED = {"l2", "euclidean", "manhattan", "l1"}


class VectorIndex:
    """An inverted-file index: rows belong to the nearest of a bounded number of centroids, a search probes a few.

    Centroids are refined on a sample of at most ``sample`` rows, in one task; all rows are indexed, and their cells are written as
    folders of the shared folder, so a search reads the cells that it probes. Inserts and deletes keep the index in step. A search probes the nearest cells first, then every further cell that may hold a row as near as the
    k-th found (distance to its centre less its radius), so no neighbour is lost; where the metric has no such bound
    (cosine, inner product), it visits all cells."""

    def __init__(self, dim: int, centroids: int = 16, metric: str = "l2", sample: int = 10_000, seed: int = 3):
        self.dim, self.n, self.metric, self.sample, self.seed = dim, centroids, metric, sample, seed
        self.cells: DataFrame | None = None
        self.centres: list[list[float]] = []
        self._sizes: list[tuple[float, int]] | None = None

    def _check(self, df: DataFrame) -> DataFrame:
        bad = (F.size("embedding") != self.dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.withColumn("embedding", F.when(bad, F.raise_error(F.lit("vector of wrong dimension or not finite"))).otherwise(F.col("embedding")))

    def _assign(self, df: DataFrame) -> DataFrame:
        """vec_id, embedding and the cell of the nearest centre; rows without a vector are in cell 0."""
        centres = np.array(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.zeros(b.num_rows, np.int32)
                cell[b["embedding"].is_valid().to_numpy(zero_copy_only=False)] = _to_centres(_vectors(pa.Table.from_batches([b]), "embedding")[1], centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

        return df.mapInArrow(run, StructType([*df.schema, StructField("cell", IntegerType())]))

    def build(self, df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", rounds: int = 5) -> VectorIndex:
        rows = self._check(df.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("embedding")))
        n, dim = self.n, self.dim

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Centres of the whole sample, which is one partition."""
            v = np.concatenate([np.zeros((0, dim)), *(_vectors(pa.Table.from_batches([b]), "embedding")[1] for b in batches if b.num_rows)])
            centres = v[:n].copy()
            for _ in range(rounds if len(v) else 0):
                cell = _to_centres(v, centres).argmin(axis=1)
                for i in set(cell.tolist()):
                    centres[i] = v[cell == i].mean(axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(centres)), pa.int32()), "c": pa.array(centres.tolist(), pa.list_(pa.float64()))})

        sample = rows.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(self.seed))).limit(self.sample)
        self.centres = [list(r.c) for r in sample.coalesce(1).mapInArrow(fit, "i int, c array<double>").orderBy("i").collect()]  # at most n rows
        self.cells, self._sizes = written(self._assign(rows) if self.centres else rows.withColumn("cell", F.lit(0)), "vector-cells", "cell"), None
        self.centres = self.centres or [[0.0] * self.dim]
        return self

    def insert(self, df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", checked: bool = False) -> None:
        """Adds rows; ``checked``: their ids are known to be new."""
        new = self._check(df.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("embedding")))
        if not checked and (new.join(self.cells, "vec_id", "left_semi").limit(1).count() or new.groupBy("vec_id").count().where("count > 1").limit(1).count()):
            raise ValueError("duplicate id")
        self.cells, self._sizes = self.cells.unionByName(self._assign(new)), None

    def delete(self, ids: DataFrame) -> None:
        self.cells = self.cells.join(ids.select("vec_id"), "vec_id", "left_anti")

    def _cells(self) -> list[tuple[float, int]]:
        """The largest distance of a row to its cell's centre, -1 for an empty cell, and the cell's rows. Rows that are deleted leave it valid."""
        if self._sizes is None:
            centres = np.array(self.centres)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for t in (pa.Table.from_batches([b]).filter(b["embedding"].is_valid()) for b in batches):
                    cell = t["cell"].to_numpy()
                    r, n = np.zeros(len(centres)), np.bincount(cell, minlength=len(centres))
                    np.maximum.at(r, cell, np.sqrt(((_vectors(t, "embedding")[1] - centres[cell]) ** 2).sum(axis=1)) if len(cell) else np.zeros(0))
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(full := np.flatnonzero(n).astype(np.int32)), "r": pa.array(r[full]), "n": pa.array(n[full])})

            found = self.cells.select("cell", "embedding").mapInArrow(run, "cell int, r double, n long").groupBy("cell").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect()  # a row for each centroid
            self._sizes = [(-1.0, 0)] * len(self.centres)
            for x in found:
                self._sizes[x.cell] = (x.r, x.n)
        return self._sizes

    def search(self, query: list[float], k: int, probes: int = 4) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError("query of wrong dimension")
        spark = self.cells.sparkSession
        asked = spark.createDataFrame([(0, list(map(float, query)))], "vec_id long, embedding array<double>")
        return self.search_all(asked, k, probes).orderBy("rank").select("vec_id", "distance")

    def search_all(self, queries: DataFrame, k: int, probes: int = 4, id_col: str = "vec_id", vec: str = "embedding", blocks: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, distance: the k nearest rows of every query. Query ids are taken to be distinct.

        Queries meet the rows of a cell in blocks; each block keeps k rows per query. ``blocks`` of a cell: default by its rows."""
        asked = self._check(queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("embedding"))).where("embedding is not null")
        bounded = self.metric.lower() in BOUNDED
        sizes, batches = self._cells(), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
        parts = F.element_at(F.array(*(F.lit(blocks or max(1, math.ceil(n / BLOCK_ROWS))) for _, n in sizes)), F.col("cell") + 1)
        full = np.array([i for i, (r, _) in enumerate(sizes) if r >= 0], np.int32)
        centres, radii = np.array(self.centres)[full], np.array([sizes[i][0] for i in full])

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells of each query, nearest first, with a bound below the distances of their rows."""
            for b in batches:
                d = _to_centres(_vectors(pa.Table.from_batches([b]), "_q")[1], centres)
                order = np.argsort(d, axis=1, kind="stable")
                least = np.nan_to_num(np.take_along_axis(d - radii - 1e-9 * (d + radii), order, 1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                cells = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(len(full), dtype=np.int32), len(d))), pa.array(full[order].ravel()), pa.array(least.ravel())], ["_at", "cell", "_least"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(full)), cells)], [*b.schema.names, "_cells"])

        asked = asked.select("query_id", F.col("embedding").alias("_q"))
        asked = asked.mapInArrow(ways, StructType([*asked.schema, StructField("_cells", ArrayType(StructType([StructField("_at", IntegerType()), StructField("cell", IntegerType()), StructField("_least", DoubleType())])))]))
        asked = asked.select("query_id", "_q", F.inline("_cells"))
        rows = self.cells.select("vec_id", F.col("embedding").alias("_v"), "cell", _dealt("vec_id", parts).alias("_b")).withColumn("_c", _each(batches))

        def best(some: DataFrame) -> DataFrame:
            q = some.select("query_id", "_q", "cell", _dealt("query_id", batches).alias("_c"), _each(parts).alias("_b"))
            return _meet(rows, q, ["cell", "_b", "_c"], k, self.metric, "vec_id")

        def merged(found: DataFrame) -> DataFrame:
            order = Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("vec_id"))
            return found.select("query_id", F.row_number().over(order).cast("bigint").alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)

        if not bounded:
            return merged(best(asked))
        first = written(merged(best(asked.where(F.col("_at") < probes))), "vector-near")  # read twice below
        reach = first.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("distance").alias("_reach"))
        rest = asked.where(F.col("_at") >= probes).join(reach, F.col("query_id") == F.col("_id"), "left").where("_reach is null or _least <= _reach")
        return merged(first.select("query_id", "vec_id", "distance").unionByName(best(rest)))

    def save(self, path: str) -> None:
        self.cells.write.partitionBy("cell").parquet(f"{path}/cells")
        spark = self.cells.sparkSession
        spark.createDataFrame([(i, c) for i, c in enumerate(self.centres)], "i int, c array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "l2") -> VectorIndex:
        centres = [r.c for r in spark.read.parquet(f"{path}/centres").orderBy("i").collect()]
        out = cls(len(centres[0]), len(centres), metric)
        out.centres, out.cells = [list(c) for c in centres], spark.read.parquet(f"{path}/cells")
        return out

    def stats(self) -> DataFrame:
        return self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))

"""Mutable tables over immutable DataFrames: constraints, DML, snapshots, sequences, vector indexes.

A statement replaces a table's DataFrame by a transformed one; before that one pass over the changed rows counts what
breaks a NOT NULL, CHECK or dimension, and a grouping or a join looks for each broken key. BEGIN remembers the
DataFrames, definitions and vector indexes, ROLLBACK puts them back. After ``CUT`` changes a table's plan is cut by
checkpoint(), which writes to the session's spark.checkpoint.dir.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knn import VectorIndex
from tessera.operators.windows import unordered_row_number
from tessera.scratch import shared_dir

#: Changes after which a plan is cut.
CUT = 8
#: A column of the new row, outside strings, in the expressions of an upsert.
_EXCLUDED = re.compile(r"\bexcluded\.(\w+)(?=(?:[^']|'[^']*')*$)")


class ConstraintError(ValueError):
    pass


@dataclass
class Meta:
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    checks: list[str] = field(default_factory=list)
    foreign: list[tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=list)
    dims: dict[str, int] = field(default_factory=dict)
    indexes: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)

    @property
    def required(self) -> set[str]:
        return {f.name for f in self.schema if not f.nullable} | set(self.primary_key)


class Sequence:
    """nextval() returns and then steps; a driver-side counter. take(n) is for n rows at once."""

    def __init__(self, start: int = 1, step: int = 1):
        self.next, self.step, self.current = start, step, None

    def take(self, n: int) -> int:
        """The first of the next n values."""
        first = self.next
        if n:
            self.current, self.next = first + (n - 1) * self.step, first + n * self.step
        return first

    def nextval(self) -> int:
        return self.take(1)

    def __deepcopy__(self, memo: dict) -> Sequence:
        # a rollback keeps the numbers that were given out, so a saved DEFAULT refers to the same counter
        return self

    def currval(self) -> int:
        if self.current is None:
            raise ValueError("currval before nextval")
        return self.current


class Database:
    """Named tables with constraints. All methods return the affected rows (RETURNING) or nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.meta: dict[str, Meta] = {}
        self.sequences: dict[str, Sequence] = {}
        self.vectors: dict[str, tuple[str, str, VectorIndex]] = {}
        self._saved: tuple[dict[str, DataFrame], dict[str, Meta], dict] | None = None
        self._points: list[tuple[str, tuple[dict[str, DataFrame], dict[str, Meta], dict]]] = []
        self._changes: dict[str, int] = {}

    # --- definition ------------------------------------------------------------------------------------------

    def create(self, name: str, schema: str | T.StructType, if_not_exists: bool = False, **rules: object) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table exists: {name}")
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.meta[name] = Meta(kind, **rules)
        loose = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in kind])
        self.tables[name] = self.spark.createDataFrame([], loose)

    def drop(self, *names: str, if_exists: bool = False) -> None:
        for n in names:
            if n not in self.tables and not if_exists:
                raise KeyError(n)
            self.tables.pop(n, None)
            self.meta.pop(n, None)
            self.vectors = {i: v for i, v in self.vectors.items() if v[0] != n}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"unknown table: {name}")
        return self.tables[name]

    def add_column(self, name: str, column: str, kind: str, default: object = None, required: bool = False, dim: int | None = None) -> None:
        m = self.meta[name]
        if column in m.schema.names:
            raise ValueError(f"column exists: {column}")
        values = self._numbered(self.table(name), {column: default}) if isinstance(default, Sequence) else self.table(name).withColumn(column, F.lit(default))
        values = values.withColumn(column, F.col(column).cast(kind))
        if required:
            self._none(values.where(F.col(column).isNull()), f"null value in column {column}")
        self._put(name, values)
        m.schema = T.StructType([*m.schema.fields, T.StructField(column, T._parse_datatype_string(kind), not required)])
        if dim:
            m.dims[column] = dim
        if default is not None:
            m.defaults[column] = default

    def drop_column(self, name: str, column: str) -> None:
        m = self.meta[name]
        if column in m.primary_key or len(m.schema) == 1:
            raise ConstraintError("a key column or the last column can't be dropped")
        self.vectors = {i: v for i, v in self.vectors.items() if v[:2] != (name, column)}
        m.dims.pop(column, None)
        self._put(name, self.table(name).drop(column))
        m.schema = T.StructType([f for f in m.schema if f.name != column])
        m.defaults.pop(column, None)
        m.unique = [u for u in m.unique if column not in u]

    def rename_column(self, name: str, old: str, new: str) -> None:
        m, swap = self.meta[name], lambda cols: tuple(new if c == old else c for c in cols)
        self._put(name, self.table(name).withColumnRenamed(old, new))
        m.schema = T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable) for f in m.schema])
        m.primary_key, m.unique = swap(m.primary_key), [swap(u) for u in m.unique]
        m.foreign = [(swap(mine), other, theirs) for mine, other, theirs in m.foreign]
        if old in m.dims:
            m.dims[new] = m.dims.pop(old)
        self.vectors = {i: (t, new if (t, c) == (name, old) else c, v) for i, (t, c, v) in self.vectors.items()}
        if old in m.defaults:
            m.defaults[new] = m.defaults.pop(old)

    def rename(self, old: str, new: str) -> None:
        if new in self.tables:
            raise ValueError(f"table exists: {new}")
        self.tables[new], self.meta[new] = self.tables.pop(old), self.meta.pop(old)
        self.vectors = {i: (new if t == old else t, c, v) for i, (t, c, v) in self.vectors.items()}

    def create_index(self, name: str, index: str, columns: Iterable[str], unique: bool = False) -> None:
        columns = tuple(columns)
        if unique:
            self._unique(self.table(name), columns, "unique index")
            self.meta[name].unique.append(columns)
        self.meta[name].indexes[index] = (columns, unique)

    def create_vector_index(self, name: str, index: str, column: str, metric: str = "l2", centroids: int = 16) -> VectorIndex:
        """An index over a table's vector column; rows go by the table's key, which has to be one column. Changes of
        the table reach it."""
        m = self.meta[name]
        if len(m.primary_key) != 1:
            raise ValueError("a vector index needs a primary key of one column")
        if index in self.vectors:
            raise ValueError(f"index exists: {index}")
        found = VectorIndex(m.dims[column], centroids, metric).build(self.table(name).where(F.col(column).isNotNull()), m.primary_key[0], column)
        self.vectors[index] = (name, column, found)
        m.indexes[index] = ((column,), False)
        return found

    def vector_index(self, index: str) -> VectorIndex:
        if index not in self.vectors:
            raise KeyError(f"unknown vector index: {index}")
        return self.vectors[index][2]

    def drop_index(self, index: str) -> None:
        self.vectors.pop(index, None)
        for m in self.meta.values():
            columns, unique = m.indexes.pop(index, ((), False))
            if unique and columns in m.unique:
                m.unique.remove(columns)

    def _follow(self, name: str, gone: DataFrame | None, new: DataFrame | None) -> None:
        """Takes a table's changed rows to its vector indexes (as new objects, since a rollback keeps the old)."""
        for i, (table, column, old) in self.vectors.items():
            if table == name:
                key, index = self.meta[name].primary_key[0], copy.copy(old)
                if gone is not None:
                    index.delete(gone.select(F.col(key).alias("vec_id")))
                if new is not None:
                    index.insert(new.where(F.col(column).isNotNull()), key, column, checked=True)
                self.vectors[i] = (table, column, index)

    def create_sequence(self, name: str, start: int = 1, step: int = 1) -> Sequence:
        return self.sequences.setdefault(name, Sequence(start, step))

    # --- transactions ----------------------------------------------------------------------------------------

    def begin(self) -> None:
        if self._saved:
            raise ValueError("a transaction is already open")
        self._saved, self._points = self._state(), []

    def _state(self) -> tuple[dict[str, DataFrame], dict[str, Meta], dict]:
        return dict(self.tables), copy.deepcopy(self.meta), dict(self.vectors)

    def commit(self) -> None:
        self._saved, self._points = None, []

    def rollback(self) -> None:
        if not self._saved:
            raise ValueError("no transaction is open")
        (self.tables, self.meta, self.vectors), self._saved, self._points = self._saved, None, []

    def savepoint(self, name: str) -> None:
        if not self._saved:
            raise ValueError("no transaction is open")
        self._points.append((name, self._state()))

    def _point(self, name: str) -> int:
        found = [i for i, (n, _) in enumerate(self._points) if n == name]
        if not found:
            raise KeyError(f"unknown savepoint: {name}")
        return found[-1]

    def rollback_to(self, name: str) -> None:
        """Back to a savepoint, which stays; later ones are gone."""
        at = self._point(name)
        self.tables, self.meta, self.vectors = self._points[at][1]
        self._points[at:] = [(name, self._state())]

    def release(self, name: str) -> None:
        """Forgets a savepoint and later ones; the changes stay."""
        del self._points[self._point(name) :]

    def cut(self, df: DataFrame) -> DataFrame:
        """df with its lineage cut, so that its rows stay as they are."""
        shared_dir(self.spark)
        return df.checkpoint()

    def _put(self, name: str, df: DataFrame) -> None:
        self._changes[name] = self._changes.get(name, 0) + 1
        self.tables[name] = self.cut(df) if self._changes[name] % CUT == 0 else df

    def _numbered(self, rows: DataFrame, sequences: dict[str, Sequence]) -> DataFrame:
        """rows with columns that are counted on from sequences, one number a row."""
        rows = self.cut(unordered_row_number(rows, "_n", *rows.columns) if rows.columns else rows.withColumn("_n", F.lit(1)))
        n = rows.count()
        values = {c: F.lit(q.take(n)).cast("bigint") + (F.col("_n") - 1) * q.step for c, q in sequences.items()}
        return rows.withColumns(values).drop("_n")

    # --- constraints -----------------------------------------------------------------------------------------

    def _none(self, bad: DataFrame, what: str) -> None:
        if bad.limit(1).count():
            raise ConstraintError(what)

    def _unique(self, df: DataFrame, columns: tuple[str, ...], what: str) -> None:
        whole = df.where(" and ".join(f"`{c}` is not null" for c in columns))
        self._none(whole.groupBy(*columns).count().where("count > 1"), f"{what} violated: {', '.join(columns)}")

    def _check(self, name: str, changed: DataFrame, result: DataFrame, keys: bool = True, foreign: bool = True) -> None:
        m = self.meta[name]
        broken = [(f"null value in column {c}", F.col(c).isNull()) for c in sorted(m.required)]
        broken += [(f"check violated: {c}", F.expr(f"NOT ({c})")) for c in m.checks]
        broken += [(f"vector column {c} has {n} dimensions", (F.size(c) != n) & F.col(c).isNotNull()) for c, n in m.dims.items()]
        if broken:  # one pass for all
            found = changed.agg(*(F.bool_or(bad).alias(f"_{i}") for i, (_, bad) in enumerate(broken))).first()
            for what in (what for (what, _), hit in zip(broken, found, strict=True) if hit):
                raise ConstraintError(what)
        if keys:
            for u in [*([m.primary_key] if m.primary_key else []), *m.unique]:
                self._unique(result, u, "unique key")
        for mine, other, theirs in m.foreign if foreign else ():
            rows = changed.where(" and ".join(f"`{c}` is not null" for c in mine)).select(*mine).distinct()
            parents = self.table(other).select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(theirs)))
            on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(mine)]
            self._none(rows.join(parents, on, "left_anti"), f"foreign key violated: {', '.join(mine)}")

    # --- DML -------------------------------------------------------------------------------------------------

    def _shape(self, name: str, rows: DataFrame | list, columns: list[str] | None) -> DataFrame:
        m = self.meta[name]
        columns = columns or (rows.columns if isinstance(rows, DataFrame) else m.schema.names)
        if not isinstance(rows, DataFrame):
            kinds = T.StructType([T.StructField(c, m.schema[c].dataType) for c in columns])
            rows = self.spark.createDataFrame([tuple(r) for r in rows], kinds)
        elif rows.columns != columns:
            rows = rows.toDF(*columns)
        counted = {c: q for c, q in m.defaults.items() if isinstance(q, Sequence) and c not in columns}
        if counted:
            rows = self._numbered(rows, counted)
        full = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in columns or f.name in counted else F.lit(m.defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in m.schema]
        return rows.select(*full)

    def insert(self, name: str, rows: DataFrame | list, columns: list[str] | None = None) -> DataFrame:
        new = self._shape(name, rows, columns)
        result = self.table(name).unionByName(new)
        self._check(name, new, result)
        self._put(name, result)
        self._follow(name, None, new)
        return new

    def insert_defaults(self, name: str) -> DataFrame:
        m = self.meta[name]
        values = {c: v.nextval() if isinstance(v, Sequence) else v for c, v in m.defaults.items()}
        return self.insert(name, self.spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in m.schema)))

    def upsert(self, name: str, rows: DataFrame | list, on: tuple[str, ...] | None = None, update: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """ON CONFLICT: without ``update`` DO NOTHING, else DO UPDATE SET with expressions over the columns (old row)
        and excluded.* (new row)."""
        on = on or self.meta[name].primary_key
        new, old = self._shape(name, rows, columns), self.table(name)
        key = [F.col(f"o.{c}") == F.col(f"e.{c}") for c in on]
        fresh = new.alias("e").join(old.alias("o"), key, "left_anti")
        if update is None:
            fresh = fresh.dropDuplicates(list(on))
            result, changed = old.unionByName(fresh), fresh
        else:
            excluded = new.select(*(F.col(c).alias(f"_x_{c}") for c in new.columns), F.lit(True).alias("_hit"))
            both = old.join(excluded, [F.col(c) == F.col(f"_x_{c}") for c in on], "left")
            cols = [F.when(F.col("_hit"), F.expr(_EXCLUDED.sub(r"_x_\1", update[c]))).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in update else F.col(c) for c in old.columns]
            kept = both.select(*cols, "_hit")
            changed = fresh.unionByName(kept.where("_hit").drop("_hit"))
            result = kept.drop("_hit").unionByName(fresh)
        self._check(name, changed, result)
        self._put(name, result)
        self._follow(name, changed if update is not None else None, changed)
        return changed

    def update(self, name: str, assign: dict[str, str | Column], where: str | Column = "true") -> DataFrame:
        """SET expressions read the old row; rows where the condition is NULL stay as they are."""
        old, hit = self.table(name), F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        value = {c: F.expr(v) if isinstance(v, str) else v for c, v in assign.items()}
        marked = old.select("*", hit.alias("_hit"))
        cols = [F.when(F.col("_hit"), value[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in value else F.col(c) for c in old.columns]
        after = marked.select(*cols, "_hit")
        changed, result = after.where("_hit").drop("_hit"), after.drop("_hit")
        self._check(name, changed, result, keys=any(c in value for u in [self.meta[name].primary_key, *self.meta[name].unique] for c in u), foreign=False)
        self._put(name, result)
        self._follow(name, old.where(hit), changed)
        return changed

    def delete(self, name: str, where: str | Column = "true") -> DataFrame:
        old, hit = self.table(name), F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        self._put(name, old.where(~hit))
        self._follow(name, old.where(hit), None)
        return old.where(hit)

    def truncate(self, name: str) -> None:
        old = self.table(name)
        self._put(name, old.limit(0))
        self._follow(name, old, None)

"""Reading table folders, and writing results in the formats of the command line."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Tables of one folder as attributes, read lazily: t.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> None:
    """Temporary views of the folder's tables."""
    t = Tables(spark, folder)
    for n in names:
        getattr(t, n).createOrReplaceTempView(n)


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, (list, tuple)):
        return "'[" + ", ".join(repr(x) for x in value) + "]'"
    return "'" + str(value).replace("'", "''") + "'"


def dump_sql(name: str, df: DataFrame) -> Iterator[str]:
    """CREATE TABLE and INSERT statements, a row at a time through the driver (never the whole table at once)."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") for f in df.schema)
    yield f"CREATE TABLE {name} ({columns});"
    for row in df.toLocalIterator():
        yield f"INSERT INTO {name} VALUES ({', '.join(map(sql_literal, row))});"


def render(df: DataFrame, kind: str = "table", limit: int | None = None) -> str:
    """The rows as table, json, csv, raw (tabs) or expanded text for a person to read: all of them, fetched a
    partition at a time, or the first ``limit`` rows, which a table's last line then says. Use ``write`` for files."""
    rows, names = list(df.toLocalIterator()) if limit is None else df.limit(limit + 1).collect(), df.columns
    more = limit is not None and len(rows) > limit
    rows = rows[:limit]
    if kind == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
    if kind == "csv":
        import csv

        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(names)
        w.writerows(rows)
        return out.getvalue()
    text = [["NULL" if v is None else str(v) for v in r] for r in rows]
    if kind == "raw":
        return "\n".join("\t".join(r) for r in text)
    if kind == "expanded":
        wide = max(map(len, names), default=0)
        return "\n".join(f"-[ RECORD {i} ]\n" + "\n".join(f"{n:<{wide}} | {v}" for n, v in zip(names, r, strict=True)) for i, r in enumerate(text, 1))
    if kind != "table":
        raise ValueError(f"unknown format: {kind}")
    sizes = [max(len(n), *(len(r[i]) for r in text)) if text else len(n) for i, n in enumerate(names)]
    line = lambda cells: " | ".join(f"{c:<{s}}" for c, s in zip(cells, sizes, strict=True)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * s for s in sizes), *map(line, text), f"(first {len(rows)} rows)" if more else f"({len(rows)} rows)"])


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Source in any of Spark's file formats (parquet, csv, json, orc, text) or connectors (jdbc, kafka)."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(*([path] if path else []))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options: str) -> None:
    """Sink in any of Spark's file formats; each task writes its own files."""
    df.write.format(kind).mode(mode).options(**options).save(path)


def schema_tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables: the catalog's tables and views."""
    rows = [(t.namespace[0] if t.namespace else None, t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def schema_columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns."""
    rows = [(t.name, c.name, i, "YES" if c.nullable else "NO", c.dataType) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def pg_tables(spark: SparkSession) -> DataFrame:
    """pg_catalog.pg_tables."""
    return schema_tables(spark).where("table_type = 'BASE TABLE'").select(F.col("table_schema").alias("schemaname"), F.col("table_name").alias("tablename"))

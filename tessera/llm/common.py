"""What the operators of this package share: the scratch folder, written tables, row identity, rows taken out of a table."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: Rows of texts in an Arrow batch.
BATCH_ROWS = 1000

#: Bits of one row of an id filter (the size of bitmap_construct_agg's result), most rows (16 MiB in all), bits of an id.
FILTER_ROW, FILTER_ROWS, PROBES = 32768, 4096, 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder is
    made for a session on one machine (tests); a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Results read from it lazily, so the session's owner removes the folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Sends whole texts to Python workers in batches of at most BATCH_ROWS rows, as a batch is held in memory on both
    sides; a session setting that is lowered only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def row_key(*columns: str | Column) -> Column:
    """128 bits that stand for a row's columns: two hashes of different seeds. Equal rows have equal keys."""
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(*columns), half(F.lit("second"), *columns)))


class IdFilter:
    """A blocked Bloom filter over ids of at most FILTER_ROWS x 4 KiB, whatever their number: ``marked`` broadcasts it.
    It rules out most rows of a table without moving them; the rest need an exact join. Beyond some 20 million ids it
    rules out fewer and fewer rows, so that more of them are moved; results are the same."""

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.rows = max(1, min(FILTER_ROWS, math.ceil(24 * n / FILTER_ROW)))
        row, bits = self._places(F.col(column))
        places = ids.select(row.alias("_row"), F.explode(F.array(*(b.cast("long") for b in bits))).alias("_bit"))
        maps = places.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
        # as 64-bit words, whose bits are read without making strings
        word = lambda i: F.conv(F.hex(F.substring(F.col("_map"), i * 8 + 1, F.lit(8))), 16, -10).cast("long")
        words = maps.select("_row", F.transform(F.sequence(F.lit(0), F.lit(FILTER_ROW // 64 - 1)), word).alias("_map"))
        self.table = written(words, "id-filter")

    def _places(self, column: Column) -> tuple[Column, list[Column]]:
        h = F.xxhash64(F.lit("bit"), column)
        return F.pmod(F.xxhash64(column), F.lit(self.rows)).cast("int"), [F.pmod(F.shiftright(h, 15 * j), F.lit(FILTER_ROW)).cast("int") for j in range(PROBES)]

    def marked(self, docs: DataFrame, column: Column, name: str) -> DataFrame:
        """docs with a column ``name``: whether the value of ``column`` may be among the ids (of the same type)."""
        row, bits = self._places(column)
        r, m = fresh(docs, "_filter_row"), fresh(docs, "_filter_map")
        table = self.table.select(F.col("_row").alias(r), F.col("_map").alias(m))
        place = lambda bit: (7 - F.shiftright(bit, 3).bitwiseAND(7)) * 8 + bit.bitwiseAND(7)
        hit = reduce(lambda x, y: x & y, [F.getbit(F.get(F.col(m), F.shiftright(bit, 6)), place(bit)) == 1 for bit in bits])
        return docs.withColumn(r, row).join(F.broadcast(table), r, "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(r, m)


def without(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs without the rows named by ``gone`` (_i long: id, _k: key of the row, _once: whether one row of these stays).

    The id filter rules out most rows that stay, which are not moved; the others meet ``gone`` in a join on id and
    key, so only they are shuffled. One plan at all sizes. All columns stay, whatever their names."""
    gone = written(gone, "gone")
    i, k, o = (fresh(docs, n) for n in ("_own_id", "_own_key", "_once"))
    maybe, sure = dealt(docs, IdFilter(gone, "_i"), F.col(id_col).cast("long"))
    theirs = gone.select(F.col("_i").alias(f"{i}_"), F.col("_k").alias(f"{k}_"), F.col("_once").alias(o))
    maybe = maybe.withColumn(i, F.col(id_col).cast("long")).withColumn(k, key)
    met = maybe.join(theirs, F.col(i).eqNullSafe(F.col(f"{i}_")) & (F.col(k) == F.col(f"{k}_")), "left")
    out = sure.unionByName(met.where(F.col(o).isNull()).select(*docs.columns))
    if not gone.where("_once").limit(1).count():
        return out
    again = met.where(F.col(o)).dropDuplicates([i, k])
    return out.unionByName(again.select(*docs.columns))


def semi(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in keys (a written table with that column and others): rows that the id filter rules
    out are not moved, the others meet the keys in a join of two exchanged sides."""
    maybe, _ = dealt(rows, IdFilter(keys, column), F.col(column))
    return maybe.join(keys, column)


def dealt(rows: DataFrame, ids: IdFilter, column: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be among the ids, and the others."""
    hit = fresh(rows, "_hit")
    marked = ids.marked(rows, column, hit)
    return marked.where(F.col(hit)).drop(hit), marked.where(~F.col(hit)).drop(hit)

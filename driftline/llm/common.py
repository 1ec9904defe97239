"""Shared folder handling, word splitting and helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word and space classes of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch at most, as texts may be long and workers share an executor's memory with its heap.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches unless the session sets smaller ones; results don't depend on them."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, whole."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder URI below spark.checkpoint.dir, which the whole cluster sees.

    Only where that setting is absent and the master is local (tests), a temporary folder is made and set.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Parquet's settings for tables of large rows: row groups of about 8 MB, their size looked at after each row (after 100 as
#: it comes). Writers hold a row group, and the columnar reader up to 4,096 rows of one.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a hash filter, as a power of two: 2 MB, whatever it is made of.
FILTER_BITS = 24


def hash_filter(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the top FILTER_BITS bits of a column of 64-bit hashes, for ``passes``.

    It is collected as at most 2 ** (FILTER_BITS - 6) rows. Made of many more hashes than bits, it lets more through;
    what passes is joined afterwards, so that changes no result.
    """
    word = F.shiftrightunsigned(column, 70 - FILTER_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - FILTER_BITS}) & 63 as int))")
    rows = df.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).filter("word is not null").collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (64 bits, of either sign) a filter lets through: all that it was made of, and some others."""
    at = hashes.view(np.uint64) >> np.uint64(59 - len(bits).bit_length())
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def words(text: Column) -> Column:
    """Words of a text (null: none), as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished queries now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def merge_span_rows(spans: DataFrame, by: tuple[str, ...] = ("_k",)) -> DataFrame:
    """``spans`` by the columns ``by``: their rows ``s, e`` (half-open) merged to maximal runs, in order."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(*by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))

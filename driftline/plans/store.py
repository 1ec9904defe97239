"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch at most, as workers that share an executor each hold some.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches unless the session sets smaller ones; results don't depend on them."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def commit_table(df: DataFrame, path: str) -> None:
    """Put ``df`` in the place of the table at ``path`` at once: a new version is written whole, then a pointer is renamed to name it.

    A write that dies before the rename leaves the old version. ``df`` may be made from the table itself. Versions that no
    pointer names any more stay until ``drop_versions``.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    part, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"CURRENT.{version}.part", "CURRENT"))
    files = pointer.getFileSystem(conf)
    out = files.create(part, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, pointer, overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer at ``path`` names; none before the first commit."""
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    files = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` as last committed; empty before the first commit."""
    version = current_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{version}") if version else spark.createDataFrame([], schema)

"""The stages as streams: files arrive, each micro-batch runs the batch operators and commits tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.delta import extend_ledger, filter_unseen


def first_sightings(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, day: Callable[[int], date]) -> None:
    """Read what files of ``source`` bring, pass items never seen on an earlier day, and keep the ledger.

    The ledger is a table, as its keys never expire and do not belong in stream state. Each micro-batch writes items and
    ledger additions to partitions named after it, so a batch that runs twice overwrites itself.
    """

    def commit(batch: DataFrame, number: int) -> None:
        as_of = day(number)
        try:
            ledger = spark.read.parquet(f"{out}/ledger").filter(F.col("batch") != number).drop("batch")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = spark.createDataFrame([], f"{key} string, first_seen date")
        fresh = filter_unseen(batch.dropDuplicates([key]), ledger, as_of, key)
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/items")
        grown = extend_ledger(batch, ledger, as_of, key).join(ledger.select(key), key, "left_anti")
        grown.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/ledger")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type and window of event time; rows later than the watermark are left out when it runs as a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")

"""Sinks that a stream may replay.

A batch is a folder with its number; a batch that runs again replaces what it wrote.
Nothing here depends on how late a row comes: what was seen before is looked up in
what was written, by key and day, so a stream keeps no rows in its state and loses
none to a watermark.  Rows that come later than a lateness allows are kept like all
others and marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = T.StructType().add("n", "long").add("n_late", "long").add("max_ts", "timestamp")


def _files(spark: SparkSession, folder: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_batch(batch: DataFrame, folder: str, number: int, *by: str) -> None:
    """A batch that runs again replaces what it wrote before."""
    batch.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/batch={number}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``write_batch`` has written, with the number in ``batch``; empty if nothing came."""
    numbered = T.StructType([*schema, T.StructField("batch", T.LongType())])
    where, system = _files(spark, folder)
    if not system.exists(where):
        return spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).parquet(folder)


def numbers_of(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the finished folders ``name=number`` of ``folder``, rising."""
    where, system = _files(spark, folder)
    if not system.exists(where):
        return []
    found = [status.getPath() for status in system.listStatus(where)]
    success = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(path.getName().split("=")[1]) for path in found
                  if path.getName().startswith(f"{name}=")
                  and system.exists(success(path, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    where, system = _files(spark, path)
    system.delete(where, True)


def take_new(batch: DataFrame, folder: str, number: int, key: str, lateness: str) -> DataFrame:
    """The rows of ``batch`` whose ``key`` no earlier batch brought, each once.

    They are written below ``folder`` with the mark ``late``: older, by more than
    ``lateness``, than the newest row of the batches before.  An event keeps its time,
    so only the days of the batch are looked up.  Rows without a key are all new.
    """
    spark = batch.sparkSession
    timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    stored = T.StructType([*timed.schema, T.StructField("late", T.BooleanType()),
                           T.StructField("day", T.DateType())])
    newest = (read_batches(spark, f"{folder}/commits", COMMIT).where(F.col("batch") < number)
              .agg(F.max("max_ts").alias("ts")).first()["ts"])
    known = read_batches(spark, f"{folder}/seen", stored).where(F.col("batch") < number)
    rows = timed.withColumn("day", F.to_date("ts")).withColumn(
        "late", F.lit(False) if newest is None else F.coalesce(
            F.col("ts") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}"),
            F.lit(False)))
    keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    days = keyed.select("day").distinct()
    known = known.join(F.broadcast(days), known["day"].eqNullSafe(days["day"]), "left_semi")
    new = keyed.join(known.select(key), key, "left_anti").unionByName(
        rows.where(F.col(key).isNull()))
    write_batch(new.select(*stored.fieldNames()), f"{folder}/seen", number, "day")
    written = read_batches(spark, f"{folder}/seen", stored).where(F.col("batch") == number)
    write_batch(written.agg(F.count(F.lit(1)).alias("n"),
                            F.count(F.when(F.col("late"), 1)).alias("n_late"),
                            F.max("ts").alias("max_ts")), f"{folder}/commits", number)
    return written.drop("batch", "day", "late")


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of ``take_new`` that came late, with their batch."""
    stored = T.StructType([*schema, T.StructField("late", T.BooleanType()),
                           T.StructField("day", T.DateType())])
    return read_batches(spark, f"{folder}/seen", stored).where("late").drop("late", "day")

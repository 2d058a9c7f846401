"""Live counters over a stream of events.

Every batch adds its part of the counts to a folder; parts of one group are merged
when they are read, and every ``COMPACT_EVERY`` batches into a snapshot, so that
reading and storing follow the number of groups and not of batches.  An event
delivered twice (by ``event_id``) counts once, and one that comes late still counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import work_path
from larder.streaming.ingest import LATENESS, run
from larder.streaming.sink import (
    late_rows, numbers_of, read_batches, remove, take_new, write_batch)

COMPACT_EVERY = 16
MERGE = {"n": F.sum, "first_ts": F.min, "last_ts": F.max}

# Every counter takes, for streams that go on later, the ``folder`` its parts are
# written to, the ``checkpoint`` and the ``trigger``; give the same ones again.


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        *(MERGE[c](c).alias(c) for c in parts.columns if c in MERGE))


def _state(spark, folder: str, schema: T.StructType, keys: list[str], upto: int | None = None
           ) -> DataFrame:
    """The counts after batch ``upto``: the last snapshot before it and the parts since."""
    snapshots = [n for n in numbers_of(spark, f"{folder}/snapshots", "upto")
                 if upto is None or n < upto]
    parts = read_batches(spark, f"{folder}/parts", schema)
    if upto is not None:
        parts = parts.where(F.col("batch") <= upto)
    if snapshots:
        parts = parts.where(F.col("batch") > snapshots[-1])
        old = spark.read.schema(schema).parquet(f"{folder}/snapshots/upto={snapshots[-1]}")
        return _merged(parts.drop("batch").unionByName(old), keys)
    return _merged(parts.drop("batch"), keys)


def _compact(spark, folder: str, schema: T.StructType, keys: list[str], number: int) -> None:
    """Write the snapshot after ``number``; what it needs stays until the next one."""
    _state(spark, folder, schema, keys, number).write.mode("overwrite").parquet(
        f"{folder}/snapshots/upto={number}")
    old = [n for n in numbers_of(spark, f"{folder}/snapshots", "upto") if n < number]
    if old:
        for n in numbers_of(spark, f"{folder}/parts", "batch"):
            if n <= old[-1]:
                remove(spark, f"{folder}/parts/batch={n}")
        for n in old[:-1]:
            remove(spark, f"{folder}/snapshots/upto={n}")


def _counter(events: DataFrame, count, keys: list[str], lateness: str, folder: str | None = None,
             checkpoint: str | None = None, trigger: dict | None = None,
             compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Work off the stream with ``count``, which sums up a batch, and read the counts."""
    spark = events.sparkSession
    folder = folder or work_path(spark, "counters")
    schema = count(spark.createDataFrame([], events.schema)).schema

    def write(batch: DataFrame, number: int) -> None:
        if "event_id" in batch.columns:
            batch = take_new(batch, f"{folder}/events", number, "event_id", lateness)
        write_batch(count(batch), f"{folder}/parts", number)
        if number % compact_every == compact_every - 1:
            _compact(spark, folder, schema, keys, number)

    run(events, write, "append", checkpoint, trigger)
    return _state(spark, folder, schema, keys)


def late_events(events: DataFrame, folder: str) -> DataFrame:
    """Rows that a counter of ``events`` got late, with their batch; they are counted."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return late_rows(events.sparkSession, f"{folder}/events", timed.schema)


def daily_counts(events: DataFrame, kind: Column, lateness: str = LATENESS,
                 **where) -> DataFrame:
    """``day, kind, n`` in tumbling windows of a day."""
    def count(rows: DataFrame) -> DataFrame:
        windows = rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(
            F.window("ts", "1 day").alias("w"), kind.alias("kind")).agg(
            F.count(F.lit(1)).alias("n"))
        return windows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n")

    return _counter(events, count, ["day", "kind"], lateness, **where)


def sessions(events: DataFrame, key: str = "session_id", lateness: str = LATENESS,
             **where) -> DataFrame:
    """First and last event and number of events per session."""
    def count(rows: DataFrame) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return rows.groupBy(key).agg(
            F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
            F.count(F.lit(1)).alias("n"))

    return _counter(events, count, [key], lateness, **where)


def visits(events: DataFrame, key: str = "session_id", gap: str = "30 minutes",
           lateness: str = LATENESS, folder: str | None = None, checkpoint: str | None = None,
           trigger: dict | None = None) -> DataFrame:
    """Stretches of activity parted by ``gap`` without events.

    A stretch is written once, when the watermark has passed its end, and leaves the
    state then; the last ones stay open.  An event that comes later than ``lateness``
    cannot change a written stretch and is left out; a counter of the same stream
    names such events (``late_events``).
    """
    spark = events.sparkSession
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    if "event_id" in events.columns:
        timed = timed.dropDuplicatesWithinWatermark(["event_id"])
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"))
    flat = grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    folder = folder or work_path(spark, "visits")
    run(flat, lambda batch, number: write_batch(batch, folder, number), "append", checkpoint,
        trigger)
    return read_batches(spark, folder, flat.schema).drop("batch")

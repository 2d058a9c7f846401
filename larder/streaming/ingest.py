"""Event ingest: a stream of user actions to the log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans.feedback import fan_out
from larder.session import work_path
from larder.sources.eventlog import EventLog
from larder.streaming.sink import read_batches, take_new

LATENESS = "10 minutes"


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()) \
        .getFileStatus(where).isDirectory()


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream: the files of a folder, or one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if is_folder(spark, path):
        folder, name = path, "*.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(folder)


def run(stream: DataFrame, write, mode: str, checkpoint: str | None = None,
        trigger: dict | None = None) -> None:
    """Work off the stream; ``write`` gets each batch and its number.

    By default that is what is there now.  With another ``trigger`` the call
    returns when the query is stopped.  The same ``checkpoint`` goes on where
    an earlier call stopped.
    """
    checkpoint = checkpoint or work_path(stream.sparkSession, "stream-checkpoint")
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()


def deduplicated(events: DataFrame, folder: str, key: str = "event_id",
                 lateness: str = LATENESS, checkpoint: str | None = None,
                 trigger: dict | None = None) -> DataFrame:
    """Work off the stream and read each event once, however late it came."""
    spark = events.sparkSession
    run(events, lambda batch, number: take_new(batch, folder, number, key, lateness), "append",
        checkpoint, trigger)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).schema
    return read_batches(spark, f"{folder}/seen", timed).drop("batch")


def ingest(actions: DataFrame, log: EventLog, folder: str | None = None,
           checkpoint: str | None = None, trigger: dict | None = None,
           name: str = "ingest") -> dict[str, DataFrame]:
    """Route actions, each event once, to the tables of ``log``.

    ``folder`` keeps what was seen; give it and the ``checkpoint`` again to go on.  A
    batch is written under the commit ``name-number``, so a batch that runs again
    replaces its rows.  Returns the tables; a session's logins may come in several
    batches, and its start is its first login.
    """
    spark = actions.sparkSession
    folder = folder or work_path(spark, "log-events")
    log.setup()

    def write(batch: DataFrame, number: int) -> None:
        new = take_new(batch, folder, number, "event_id", LATENESS)
        for table, rows in fan_out(new).items():
            log.append(table, rows, commit=f"{name}-{number}")

    run(actions, write, "append", checkpoint, trigger)
    tables = {t: log.read(t) for t in
              ("user_sessions", "user_feedback", "user_clicks", "bad_image_feedback")}
    return {**tables, "user_sessions": first_logins(tables["user_sessions"])}


def first_logins(sessions: DataFrame) -> DataFrame:
    """The first row of every session."""
    others = [c for c in sessions.columns if c != "session_id"]
    return sessions.groupBy("session_id").agg(
        F.min_by(F.struct(*others), "ts").alias("first")).select(
        *(F.col(c) if c == "session_id" else F.col(f"first.{c}") for c in sessions.columns))

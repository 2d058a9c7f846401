"""The append-only event log: nine Parquet tables partitioned by commit and day."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import EVENT_LOG
from larder.session import materialise

DAY = "log_date"
COMMIT = "commit_id"
DIRECT = "direct"  # rows that no batch of a stream wrote


class EventLog:
    def __init__(self, spark: SparkSession, database: str = "larder_log",
                 location: str | None = None):
        self.spark, self.database, self.location = spark, database, location

    def _name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def setup(self) -> None:
        """Create what does not exist yet."""
        where = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}{where}")
        for table, schema in EVENT_LOG.items():
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} "
                           f"({columns}, {COMMIT} string, {DAY} date) USING parquet "
                           f"PARTITIONED BY ({COMMIT}, {DAY})")

    def reset(self) -> None:
        """Drop all tables and create them empty."""
        for table in EVENT_LOG:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        self.setup()

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table)).drop(DAY, COMMIT)

    def append(self, table: str, rows: DataFrame, commit: str = DIRECT) -> DataFrame:
        """Append a batch and return it with its keys and times.

        Rows of a named ``commit`` take the place of those that it wrote before, so a
        batch of a stream may be written any number of times.
        """
        stamped = materialise(stamp(table, rows), "stamped")
        if commit != DIRECT:
            self._take_back(table, commit)
        (stamped.withColumn(COMMIT, F.lit(commit)).withColumn(DAY, F.to_date("ts"))
         .write.insertInto(self._name(table)))
        return stamped

    def _take_back(self, table: str, commit: str) -> None:
        """Drop what ``commit`` has written: its partitions, one per day."""
        written = self.spark.sql(f"SHOW PARTITIONS {self._name(table)} "
                                 f"PARTITION ({COMMIT} = '{commit}')").collect()
        for row in written:
            day = row["partition"].split(f"{DAY}=")[1]
            self.spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS PARTITION "
                           f"({COMMIT} = '{commit}', {DAY} = DATE '{day}')")

    def create_sessions(self, users: DataFrame) -> DataFrame:
        """``username`` -> ``session_id``; live sessions get a random id."""
        if "session_id" not in users.columns:
            users = materialise(users.withColumn("session_id", F.expr("uuid()")), "sessions")
        return self.append("user_sessions", users)

    def store_queries(self, queries: DataFrame, commit: str = DIRECT) -> DataFrame:
        return self.append("user_queries", queries, commit)

    def store_retrieved(self, rows: DataFrame, commit: str = DIRECT) -> DataFrame:
        return self.append("retrieved_recipes", rows, commit)

    def store_assessed(self, rows: DataFrame, commit: str = DIRECT) -> DataFrame:
        return self.append("assessed_recipes", rows, commit)

    def store_recommended(self, rows: DataFrame, commit: str = DIRECT) -> DataFrame:
        return self.append("recommended_recipes", rows, commit)

    def store_clicks(self, rows: DataFrame) -> DataFrame:
        return self.append("user_clicks", rows)

    def save_feedback(self, rows: DataFrame) -> DataFrame:
        return self.append("user_feedback", rows)

    def store_adjustments(self, rows: DataFrame, commit: str = DIRECT) -> DataFrame:
        return self.append("query_adjustments", rows, commit)

    def store_bad_images(self, rows: DataFrame) -> DataFrame:
        return self.append("bad_image_feedback", rows)


def stamp(table: str, rows: DataFrame) -> DataFrame:
    """Bring rows to a log table's columns; time and key are filled in.

    The default time is one value for the batch, taken now.  A key that is not
    given is random, so that equal actions have keys of their own; write the
    result before reading it twice.
    """
    schema = EVENT_LOG[table]
    if "ts" not in rows.columns:
        rows = rows.withColumn("ts", F.lit(datetime.now(timezone.utc)))
    if "id" in schema.fieldNames() and "id" not in rows.columns:
        rows = rows.withColumn("id", F.expr("uuid()"))
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])

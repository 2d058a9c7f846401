"""Columns of the input tables and the tasks over their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.words import Words, slices

BATCH_ROWS = 1_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, as the given types; others may clash."""
    return df.select(*(df[name].cast(kind).alias(name) for name, kind in columns.items()))


def texts(docs: DataFrame, *more: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``doc_id``, the columns ``more`` and ``text``.

    Rows go to Python in batches of at most ``batch_rows`` from here on: texts and
    sets of shingles are long, and a batch is held by both sides.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return pick(docs, doc_id="long", **dict.fromkeys(more, "string"), text="string")


def map_texts(df: DataFrame, task: Callable[[pa.RecordBatch, Words], pa.RecordBatch],
              schema: T.StructType | str) -> DataFrame:
    """``task`` over slices of whole texts of the column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                yield task(batch.slice(low, high - low), Words(data, offsets))

    return df.mapInArrow(run, schema)


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id`` and the column ``name`` as 0 or 1, one row a document.

    Rows without either are no labels; a document labelled both ways keeps 1.
    """
    return (pick(labels, doc_id="long", **{name: "int"}).dropna()
            .groupBy("doc_id").agg(F.max(F.col(name).cast("boolean").cast("int")).alias(name)))

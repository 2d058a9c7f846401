"""Recommendations for a stream of requests against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.fulltext import TextIndex
from larder.plans.recommend import answer
from larder.session import work_path
from larder.streaming.ingest import run
from larder.streaming.sink import read_batches, write_batch


def recommend_stream(requests: DataFrame, index: TextIndex, corpus: DataFrame,
                     folder: str | None = None, checkpoint: str | None = None,
                     trigger: dict | None = None, name: str = "recommend",
                     **options) -> tuple[DataFrame, DataFrame]:
    """Answer every micro-batch; returns the recommendations and the status.

    With a ``log`` the steps are logged under the commit ``name-number``, once for a
    batch however often it runs.

    The same ``folder`` and ``checkpoint`` go on where an earlier call stopped.
    """
    spark = requests.sparkSession
    key = requests.schema["query_id"]
    recommended = T.StructType([key]).add("position", T.IntegerType()).add(
        "index", T.LongType()).add("relevance_score", T.IntegerType())
    status = T.StructType([key]).add("status", T.StringType()).add(
        "recommendations", T.LongType()).add("message", T.StringType())
    folder = folder or work_path(spark, "answers")

    def write(batch: DataFrame, number: int) -> None:
        _, outcome, results = answer(batch, index, corpus, commit=f"{name}-{number}", **options)
        for part, rows, schema in (("recommended", results.recommended, recommended),
                                   ("status", outcome, status)):
            write_batch(rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)),
                        f"{folder}/{part}", number)

    run(requests, write, "append", checkpoint, trigger)
    return tuple(read_batches(spark, f"{folder}/{part}", schema).drop("batch")
                 for part, schema in (("recommended", recommended), ("status", status)))

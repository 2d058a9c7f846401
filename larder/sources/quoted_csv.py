"""CSV whose quoted fields hold line breaks, read in splits.

Whether a split begins inside quotes is the parity of the quotes before it, so one
pass counts the quotes of every split and a running sum over that small table tells
every split its state.  A split then puts its lines together to records; the pieces
of a record that crosses splits, at most two a split, are joined afterwards.  Records
are parsed by Spark's own parser.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import materialise

PIECES = "file string, block long, place long, part string, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every split and what it has of records that cross its borders.

    ``part`` is whole; tail for the beginning of a record that goes on; head for the
    end of one, and inner for a split that lies in one.  ``place`` counts the records
    that begin in the split.
    """
    where, held, place, inside = None, [], 0, False
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((*where, place, "inner" if inside else "tail", "\n".join(held)))

    for batch in batches:
        odd = pc.fill_null(pc.count_substring(batch.column("value"), '"'), 0).to_numpy() % 2
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "opened", "value")]
        for file, block, opened, line, turn in zip(*columns, odd.astype(bool).tolist()):
            if (file, block) != where:
                close()
                where, held, place, inside = (file, block), [], 0, opened
                unfinished = opened
            held.append(line)
            unfinished ^= turn
            if unfinished:
                continue
            text = "\n".join(held)
            held = []
            if inside:
                out.append((*where, -1, "head", text))
                inside = False
            elif text.strip():
                out.append((*where, place, "whole", text))
                place += 1
        if len(out) >= 1_000:
            yield _batch(out)
            out = []
    close()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        names=["file", "block", "place", "part", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, text`` of the records of the files of ``path``, headers too."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialise(  # one row per split
        lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")).select(
            "file", "block",
            (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("opened")),
        "csv-splits")
    # a broadcast join leaves the lines in their order
    pieces = materialise(lines.join(F.broadcast(splits), ["file", "block"]).select(
        "file", "block", "opened", "value").mapInArrow(_pieces, PIECES), "csv-pieces")
    crossing = pieces.where("part <> 'whole'")
    upto = Window.partitionBy("file").orderBy("block", "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = crossing.withColumn(
        "record", F.count(F.when(F.col("part") == "tail", 1)).over(upto)).groupBy(
        "file", "record").agg(
        F.min(F.when(F.col("part") == "tail", F.struct("block", "place"))).alias("at"),
        F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("parts"))
    joined = joined.select("file", "at.block", "at.place",
                           F.array_join(F.col("parts")["text"], "\n").alias("text"))
    return pieces.where("part = 'whole'").select("file", "block", "place", "text").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, name: str = "index"
                    ) -> DataFrame:
    """The rows of the files of ``path``, with the columns of ``schema`` and their number
    from 0 in the order of the files.

    Every file has a header, which must name the columns of ``schema``.  A file may be
    read by any number of tasks; empty lines are skipped, and an unclosed quote at the
    end of a file takes in the rest of it.
    """
    found = materialise(records(spark, path), "csv-records")
    first = F.struct("block", "place")
    headers = found.groupBy("file").agg(F.min_by("text", first).alias("text"),
                                        F.min(first).alias("at"))
    kinds = headers.select(F.rtrim(F.replace("text", F.lit("\r"))).alias("text")).distinct().limit(2)
    for row in kinds.collect():
        if next(csv.reader([row["text"].lstrip("﻿")])) != schema.fieldNames():
            raise ValueError(f"header does not name the columns: {row['text']}")
    rows = found.join(headers.select("file", "at.block", "at.place"),
                      ["file", "block", "place"], "left_anti")
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"),
                                               F.min("place").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(  # one row per split
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        .alias("offset")), "csv-offsets")
    text = F.regexp_replace("text", r"\r$", "")
    parsed = rows.join(F.broadcast(offsets), ["file", "block"]).select(
        F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "),
                   {"quote": '"', "escape": '"'}).alias("row"),
        (F.col("offset") + F.col("place")).alias(name))
    return parsed.select("row.*", name)

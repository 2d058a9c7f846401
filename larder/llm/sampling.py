"""Bounded samples of labelled rows, and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.words import BASE, BYTE_CODES, LOWER, Words, rolled, windows

FOLDS = 5
SHINGLE_BASE = 0x8EBC6AF09C88C6E3


def held_out() -> Column:
    """Whether labels of the row are kept from every fit."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def draw(rows: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """``n`` rows of ``rows`` by a hash of doc_id; each task keeps no more than ``n``."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return rows.select("doc_id", *columns).orderBy(order, "doc_id").limit(n)


def one_text(rows: DataFrame) -> DataFrame:
    """``rows`` with one row per doc_id, that with the least text; a repeated id may have
    any number of rows, and a drawn id is to bring one."""
    others = [F.min_by(c, "text").alias(c) for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), *others)


def least_shingle(words: Words) -> np.ndarray:
    """The least hash of five words in a row of every text, equal for most near copies."""
    starts = words.window_starts(5)
    value = windows(words.hashes(lower=True), starts, 5, SHINGLE_BASE)
    least = np.full(words.texts, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, words.text[starts], value)
    whole = rolled(BYTE_CODES[LOWER[words.data]], words.offsets[:-1], words.offsets[1:], BASE)
    return np.where(words.counts >= 5, least, whole)

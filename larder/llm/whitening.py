"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become whole numbers.  The distinct vectors, centred and numbered, are cut
into blocks of rows; the transpose of that block matrix times itself is the scatter,
whose dimension is that of a vector, and its eigenvectors are found on the driver.
A second block matrix of all rows, multiplied by the whitening matrix, gives the
projections.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialise

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK_BYTES = 4 << 20  # of a block of rows in double precision
LARGEST = 2.0 ** 46  # entries from here on have no whole number of 64 bits with room to add
RANK = 1e-12  # of the greatest eigenvalue; components below have no direction of their own
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")
TASK_ROWS = 1 << 33  # of monotonically_increasing_id


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that have a whole vector, of the most common length."""
    entries = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & F.forall(
            "c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    length = (entries.groupBy(F.size("c").alias("dim")).count()
              .orderBy(F.desc("count"), F.desc("dim")).first())
    return entries.where(F.size("c") == (length["dim"] if length else 0)).select(
        "vec_id", F.transform("c", lambda c: F.floor(SCALE * c) + SHIFT).alias("x"))


def number_rows(df: DataFrame, label: str) -> DataFrame:
    """``df``, written, with a column ``index`` from 0 without gaps.

    Rows are numbered inside each task; the counts, one per task, give the offsets.
    """
    written = materialise(df.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.floor(F.col("at") / TASK_ROWS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy(part.alias("part")).count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return (written.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("index", F.col("before") + F.col("at") % TASK_ROWS)
            .drop("part", "before", "at"))


def block_matrix(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """The block matrix of ``index`` and ``centred`` of ``rows``."""
    indexed = MLUtils.convertVectorColumnsFromML(
        rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(
        max(1, BLOCK_BYTES // (8 * dim)), dim)


def local_block(spark, values: np.ndarray) -> BlockMatrix:
    """A small matrix as a block matrix of one block."""
    block = DenseMatrix(*values.shape, values.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)]), *values.shape)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of ``matrix`` times ``matrix``.

    Every block of rows meets itself in a task of its own and the products are added,
    which is what the last argument is for; by default one task would get all blocks.
    """
    splits = max(1, -(-n // matrix.rowsPerBlock))
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def indexed_rows(matrix: BlockMatrix) -> DataFrame:
    """``index, vector`` of a block matrix."""
    rows = matrix.toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("vector"))


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]        # per dimension, of the fit list
    matrix: np.ndarray     # dimensions x components
    explained: np.ndarray  # per component
    identity_error: float


def centred(x: str, sums: list[int], n: int):
    """n * x - S, whole, and x - S / n."""
    total = F.array(*(F.lit(s).cast("long") for s in sums))
    whole = F.zip_with(F.col(x), total, lambda a, s: F.lit(n).cast("long") * a - s)
    return whole, F.transform(whole, lambda v: v.cast("double") / F.lit(float(n)))


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the column ``x`` of ``x``, each distinct vector once; None without a direction."""
    numbered = number_rows(x.select("x").distinct(), "whitening-fit")
    n = numbered.count()
    if not n:
        return None
    totals = (numbered.select(F.posexplode("x").alias("at", "v")).groupBy("at")
              .agg(F.sum("v").alias("s")).orderBy("at").collect())  # one row per dimension
    sums = [row["s"] for row in totals]
    dim = len(sums)
    if not dim:
        return None
    fit = block_matrix(numbered.select("index", centred("x", sums, n)[1].alias("centred")), n, dim)
    covariance = scatter(fit, n) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    if not len(order):
        return None
    values, vectors = values[order], vectors[:, order]
    # a fixed sign, so that reruns agree
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    matrix = vectors / np.sqrt(values)
    white = scatter(fit.multiply(local_block(x.sparkSession, matrix)), n) / n
    return Whitening(n, sums, matrix, values / np.trace(covariance),
                     float(np.abs(white - np.eye(len(order))).max()))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of ``vectors`` (vec_id, embedding).

    Entries c become floor(64 * c) + 1000000.  The fit list holds each distinct vector
    once; n, the covariance and its eigenvectors are of that list.  Returns, for every
    row and component: vec_id, component (from 1 by falling eigenvalue), n, deviation
    (sum of (n * x - S)^2 over the dimensions, null if it needs more than 64 bits),
    whitened, explained (share of the trace) and identity_error.

    Dropped are rows whose vector is null, holds null, non-finite or 2^46 or more in
    size, or has not the most common length (of equally common ones the longest).
    Repeated ids and rows get their components each, null ids too.  Components whose
    eigenvalue is zero (fewer distinct vectors than components, or constant entries)
    have no direction and get no row; one distinct vector or an empty table gives an
    empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialise(whole_vectors(vectors), "whole-vectors")
    fitted = fit_whitening(rows, components)
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    n, dim = fitted.n, len(fitted.sums)
    whole, real = centred("x", fitted.sums, n)
    numbered = number_rows(rows, "whitening-rows")
    square = F.aggregate(whole, F.lit(0).cast("decimal(38,0)"), lambda total, v: (
        total + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    placed = numbered.select("vec_id", "index", square.try_cast("long").alias("deviation"))
    matrix = block_matrix(numbered.select("index", real.alias("centred")), numbered.count(), dim)
    white = indexed_rows(matrix.multiply(local_block(spark, fitted.matrix)))
    share = F.array(*(F.lit(float(e)) for e in fitted.explained))
    return (placed.join(white, "index")
            .select("vec_id", "deviation", F.posexplode("vector").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", F.element_at(share, F.col("at") + 1)
                    .alias("explained"), F.lit(fitted.identity_error).alias("identity_error")))

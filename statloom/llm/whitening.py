"""Whitening of embeddings with distributed block matrices.

1. Components become whole numbers, ``floor(64 * c) + 1000000``. Their sums per dimension are exact; rows are centred
   by a whole number first and by its rest after, so the large common part costs no digits.
2. Centred rows get indices without gaps and become a ``BlockMatrix`` of ``BLOCK_ROWS`` rows a block. Its transpose times
   itself is the scatter; the middle dimension is split, so products of ``SPLIT_BLOCKS`` blocks are summed where they are
   and only matrices of dimension x dimension go on.
3. The driver solves the eigenproblem of one such matrix: its size depends on the dimension alone.
4. The blocks times the whitening matrix (eigenvectors over roots of eigenvalues) are the projected rows.
5. The same product over the projected rows, centred again, measures how far their covariance is from the identity.

Rows are JVM vectors throughout; no Python sees them. A vector takes part unless it is null or has a null or non-finite
component; its id may be null or repeated, each row is one vector. A shorter vector counts as filled up with zeros. A
component whose eigenvalue is zero in double precision (fewer rows than dimensions, constant dimensions) has explained 0
and whitened null, and identity_error leaves it out. Equal eigenvalues have any basis of their space. No rows, no result.
Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.registry import query, table
from statloom.llm.storage import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block, and blocks whose products are summed in one task.
BLOCK_ROWS = 4096
SPLIT_BLOCKS = 8


@dataclass(frozen=True)
class Whitening:
    """Model of a table of n vectors: sums per dimension, eigenvalues from the largest, eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    def usable(self, count: int) -> np.ndarray:
        """Which of the first components have an eigenvalue beyond rounding."""
        least = max(float(self.values[0]), 0.0) * len(self.values) * np.finfo(float).eps
        return self.values[:count] > least

    def matrix(self, count: int) -> np.ndarray:
        """The whitening matrix of the first components; columns without variance are zero."""
        use = self.usable(count)
        return np.where(use, self.vectors[:, :count] / np.sqrt(np.where(use, self.values[:count], 1.0)), 0.0)


def whole(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``row, vec_id, x``: vectors that take part, in whole numbers, stored with a row number without gaps."""
    c = F.col("embedding")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long") + shift)
    rows = embeddings.filter(c.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")
    return _numbered(rows, shift)


def _numbered(rows: DataFrame, shift: int) -> DataFrame:
    rows = rows.withColumn("task", F.shiftright("at", 33))
    # One number a task of the write before.
    parts = sorted(tuple(r) for r in rows.groupBy("task").agg(F.count("*")).collect())
    begins = np.cumsum([0] + [n for _, n in parts])
    starts = rows.sparkSession.createDataFrame([(t, int(b)) for (t, _), b in zip(parts, begins)], "task long, begin long")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    x = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x")))
    row = F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "task").select(row.alias("row"), "vec_id", x.alias("x"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension of ``x``."""
    cells = rows.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    found = sorted(tuple(r) for r in cells.collect())  # one row a dimension
    return (found[0][2] if found else 0), [total for _, total, _ in found]


def blocks(rows: DataFrame, width: int) -> BlockMatrix:
    """``rows(row, v)``, v an array of doubles, as a distributed matrix of blocks."""
    vectors = rows.select(F.col("row").alias("index"), array_to_vector("v").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"))
    # Each product reads them several times; a lost executor's blocks are made again.
    return matrix.toBlockMatrix(BLOCK_ROWS, width).persist(StorageLevel.MEMORY_AND_DISK)


def _release(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, with the middle dimension split over tasks. The Python method has no argument for that."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, on the driver: dimension x dimension."""
    splits = max(1, -(-matrix.numRowBlocks // SPLIT_BLOCKS))
    return _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def centred(rows: DataFrame, n: int, totals: list[int]) -> DataFrame:
    """``row, v``: x less the mean. The whole part of the mean is taken off in whole numbers."""
    whole_part, rest = _longs([s // n for s in totals]), F.array(*[F.lit((s % n) / n) for s in totals])
    less = F.zip_with("x", whole_part, lambda a, b: (a - b).cast("double"))
    return rows.select("row", F.zip_with(less, rest, lambda a, b: a - b).alias("v"))


def fit(rows: DataFrame) -> tuple[Whitening, BlockMatrix] | None:
    """The model of the rows of :func:`whole`, and their centred blocks."""
    n, totals = sums(rows)
    if not n or not totals:
        return None
    matrix = blocks(centred(rows, n, totals), len(totals))
    cov = scatter(matrix) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return Whitening(n, totals, np.maximum(values[::-1], 0.0), vectors[:, ::-1]), matrix


def project(matrix: BlockMatrix, model: Whitening, count: int) -> DataFrame:
    """``row, w``: the blocks times the whitening matrix."""
    w = model.matrix(count)
    local = Matrices.dense(w.shape[0], w.shape[1], w.ravel(order="F").tolist())
    context = matrix._java_matrix_wrapper._sc
    right = BlockMatrix(context.parallelize([((0, 0), local)], 1), w.shape[0], w.shape[1])
    rows = callMLlibFunc("getIndexedRows", _times(matrix, right, 1).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("w"))


def identity_error(projected: DataFrame, n: int, use: np.ndarray) -> float:
    """Largest entry of the projected rows' covariance less the identity, over the usable components."""
    means = [r[1] for r in sorted(tuple(r) for r in projected.select(F.posexplode("w")).groupBy("pos").agg(F.avg("col")).collect())]
    less = F.zip_with("w", F.array(*[F.lit(float(m)) for m in means]), lambda a, b: a - b)
    matrix = blocks(projected.select("row", less.alias("v")), len(means))
    cov = scatter(matrix) / n
    _release(matrix)
    off = np.abs(cov - np.eye(len(means)))[np.ix_(use, use)]
    return float(off.max()) if off.size else 0.0


def deviation(n: int, totals: list[int]) -> Column:
    """Sum over dimensions of (n * x - S) ^ 2, exact, as decimal(38, 0)."""
    apart = F.zip_with("x", _longs(totals), lambda a, s: (a * F.lit(n).cast("long") - s).cast("decimal(19,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(apart, zero, lambda acc, v: (acc + v * v).cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation decimal(38, 0), whitened array<double>, explained array<double>, identity_error`` for every
    vector that takes part; the arrays have the first ``count`` components."""
    rows = whole(embeddings)
    fitted = fit(rows)
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    model, matrix = fitted
    count = min(count, len(model.sums))
    use = model.usable(count)
    projected = stored(project(matrix, model, count), "projected")
    _release(matrix)
    error = identity_error(projected, model.n, use)
    flags = F.array(*[F.lit(bool(u)) for u in use])
    whitened = F.zip_with("w", flags, lambda w, u: F.when(u, w))
    share = model.values[:count] / model.trace if model.trace else np.zeros(count)
    explained = F.array(*[F.lit(float(s) if u else 0.0) for s, u in zip(share, use)])
    return rows.join(projected, "row").select(
        "vec_id", F.lit(model.n).cast("long").alias("n"), deviation(model.n, model.sums).alias("deviation"),
        whitened.alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op13_block_whitening")
def block_whitening(spark, folder):
    """All vectors on the first 32 components. Beyond a long's range (some ten million vectors) deviation fails the
    job rather than be wrong; the operator itself has it as decimal."""
    rows = whiten(table(spark, folder, "embeddings"))
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", both)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")

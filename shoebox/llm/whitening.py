"""Whitening of vectors by products of MLlib block matrices."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import compute_partitions, cut_lineage, pinned

#: Entries become floor(SCALE * c) + SHIFT, so that their sums are exact integers.
SCALE, SHIFT = 64, 1_000_000
#: Columns per block; a whole row of blocks of the scatter matrix fits any task.
BLOCK_COLUMNS = 1024
#: An eigenvalue below this share of the largest, times the dimensions, is rounding.
NOISE = 2.0**-42

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def finite(vector: Column) -> Column:
    """Not null and all entries finite; an empty vector has no dimension to whiten and is left out too."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("bigint"))


def indexed(rows: DataFrame) -> DataFrame:
    """Adds ``index`` = 0, 1, ... in the order the rows lie in.

    The rows are pinned by a reliable checkpoint, so a lost executor finds the
    same rows in the same places; nothing is sorted or shuffled.
    """
    local = pinned(rows).withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition.
    placed = local.join(F.broadcast(first), "_pid")
    index = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off")
    return placed.withColumn("index", index.cast("bigint")).drop("_mid", "_pid", "_off")


def blocks_of(rows: DataFrame, n: int, dims: int, block_rows: int) -> BlockMatrix:
    """rows: index, row (array of doubles). The n x dims matrix in blocks."""
    vectors = rows.select("index", array_to_vector("row").alias("row"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"), n, dims)
    return matrix.toBlockMatrix(block_rows, min(dims, BLOCK_COLUMNS))


def scatter(blocks: BlockMatrix, tasks: int) -> np.ndarray:
    """The transpose times the matrix, dims x dims.

    The product has few blocks, so left alone all rows would meet in a few
    tasks: the sum over row blocks is split over ``tasks`` first.
    """
    turned = blocks.transpose()
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, tasks)
    whole = BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (whole + whole.T) / 2


def spectrum(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those that are rounding are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * len(values) * NOISE
    keep = np.flatnonzero(real)[:components]
    return values[keep], vectors[:, keep]


def _local_blocks(df: DataFrame, matrix: np.ndarray) -> BlockMatrix:
    """A local matrix of dims rows as a block matrix of one block column."""
    step = min(len(matrix), BLOCK_COLUMNS)
    parts = [matrix[at : at + step] for at in range(0, len(matrix), step)]
    cells = [((i, 0), DenseMatrix(len(p), p.shape[1], p.ravel(order="F").tolist())) for i, p in enumerate(parts)]
    return BlockMatrix(df.sparkSession.sparkContext.parallelize(cells, 1), step, matrix.shape[1])


def _whiten(rows: DataFrame, dims: int, components: int, block_rows: int) -> DataFrame | None:
    """rows: vec_id, x (arrays of ``dims`` integers)."""
    spark = rows.sparkSession
    placed = indexed(rows)
    total = placed.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i))) for i in range(dims)]).head()
    n, sums = total[0], F.array(*[F.lit(s).cast("bigint") for s in total[1:]])
    off = F.zip_with("x", sums, lambda x, s: F.lit(n).cast("bigint") * x - s)
    tasks = max(1, min(compute_partitions(spark), -(-n // block_rows)))

    centred = placed.select("index", F.transform(off, lambda o: o.cast("double") / F.lit(float(n))).alias("row"))
    blocks = blocks_of(centred, n, dims, block_rows)
    covariance = scatter(blocks, tasks) / n
    values, vectors = spectrum(covariance, components)
    if not len(values):
        return None

    projected = blocks.multiply(_local_blocks(rows, vectors / np.sqrt(values))).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("index", "vector")
    white = cut_lineage(found.select("index", vector_to_array("vector").alias("row")), "white")
    means = white.agg(*[F.avg(F.get("row", F.lit(i))) for i in range(len(values))]).head()
    middle = F.array(*[F.lit(float(m)) for m in means])
    level = white.select("index", F.zip_with("row", middle, lambda z, m: z - m).alias("row"))
    again = scatter(blocks_of(level, n, len(values), block_rows), tasks) / n
    error = float(np.abs(again - np.eye(len(values))).max())

    deviation = F.aggregate(F.transform(off, lambda o: o * o), F.lit(0).cast("bigint"), lambda a, b: a + b)
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    return (
        placed.select("index", "vec_id", deviation.alias("deviation"))
        .join(white, "index")
        .select("vec_id", "deviation", F.posexplode("row").alias("_at", "whitened"))
        .select(
            "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
            F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def whiten(vectors: DataFrame, *, components: int = 32, block_rows: int = 4096) -> DataFrame:
    """Vectors on their principal components, scaled to unit variance.

    vectors: vec_id, embedding; other columns are ignored, whatever their
    names. Rows whose vector is null, empty, or holds null or non-finite
    entries are dropped; repeated rows, rows with a null id and zero vectors
    count like any other. Entries are made integers first, so sums and
    ``deviation`` are exact (an overflow of 64 bits raises). Vectors of each
    length are whitened on their own. Components without variance (more
    components than dimensions or distinct rows) have no whitened value and no
    rows; an empty table gives none. Equal eigenvalues may turn among each other.

    Rows are numbered where they lie and cut into an MLlib block matrix. To the
    driver come the sums, and the scatter matrix of dims x dims, for its
    eigenvectors; projections stay distributed. ``identity_error`` is measured
    on the values returned.
    """
    spark = vectors.sparkSession
    clean = vectors.where(finite(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), integers(F.col("embedding")).alias("x")
    )
    lengths = sorted(r[0] for r in clean.select(F.size("x").alias("dims")).distinct().collect())
    parts = [_whiten(clean.where(F.size("x") == d), d, components, block_rows) for d in lengths]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None], spark.createDataFrame([], SCHEMA))

"""Whitening of embeddings with MLlib's block matrices.

Every vector becomes whole numbers (``floor(scale * c) + shift``), so sums and deviations are exact. The centred rows get dense row numbers
and are cut into blocks of a ``BlockMatrix`` of about ``CELLS`` numbers each; its transpose times itself is the scatter matrix. The
middle dimension of that product is dealt into as many parts as there are shuffle partitions, each of which adds up its own blocks
(one result cell would otherwise mean one task for all rows). Only the dimensions by dimensions matrix comes to the driver, for ``eigh``; the
blocks are then multiplied with the whitening matrix, which projects all rows.

Row numbers: position in the written part plus the rows of the parts before it, counted by part. Nothing is sorted, no row passes the driver.

Defined results: a vector that is null, empty, or holds null or non-finite entries is dropped; so is one of another length than the
most frequent one (of equally frequent lengths the greater), which has no place in the same matrix; components without variance
(eigenvalue not above rounding) have ``whitened`` null and ``explained`` 0 and are no part of ``identity_error``, which is 0 if there
is no other; ids may be null or repeated, each row counts; ``deviation`` is null where it exceeds 64 bits; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import query, table

CELLS = 1 << 18  # numbers in a block of rows
WIDTH = 1024  # columns in a block


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x (array of long)`` of the vectors that can take part."""
    v = F.col(vector_col).cast("array<double>")
    # an infinite or missing number less itself is no number
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c - c))
    x = F.transform(v, lambda c: F.floor(c * scale) + shift)
    return rows.filter(usable).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_no``: 0 to n - 1 without a gap. The rows have to be in a table, so that reading them again gives the same parts."""
    place = F.monotonically_increasing_id()  # part in the upper 31 bits, position in the lower 33
    told = cut_lineage(rows.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = told.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row a task
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.join(sizes.select("part", before.alias("before")), "part").withColumn("row_no", F.col("before") + F.col("at")).drop("part", "at", "before")


def block_matrix(rows: DataFrame, index: str, values: str, dims: int) -> BlockMatrix:
    """The rows' arrays as a matrix of blocks; goes from the table to blocks inside the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(F.col(values)).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(max(64, CELLS // dims), min(dims, WIDTH))


def gram(blocks: BlockMatrix, parts: int) -> np.ndarray:
    """The transpose times the matrix, its middle dimension dealt into ``parts``. The result (columns by columns) comes to the driver."""
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, max(1, min(parts, blocks.numRows() // blocks.rowsPerBlock + 1)))
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def times(spark: SparkSession, blocks: BlockMatrix, right: np.ndarray) -> BlockMatrix:
    """The matrix times a small one, of which every block of rows gets the blocks of columns it needs."""
    high, wide = right.shape
    step = blocks.colsPerBlock
    parts = [((i, 0), DenseMatrix(min(step, high - i * step), wide, right[i * step : (i + 1) * step].flatten("F").tolist())) for i in range(-(-high // step))]
    return blocks.multiply(BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, wide, high, wide))


def whitened(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and its first ``components``."""
    spark = rows.sparkSession
    schema = f"vec_id {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = cut_lineage(whole_vectors(rows, id_col, vector_col, scale, shift))
    lengths = whole.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dims, n = most["dims"], most["n"]
    same = whole.filter(F.size("x") == dims)
    sums = same.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)]).first()
    total = F.array(*[F.lit(int(s)) for s in sums])
    off = F.zip_with("x", total, lambda x, s: F.lit(n) * x - s)  # n times the centred entry, exact
    exact = F.aggregate("off", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    centred = cut_lineage(numbered(same.select("vec_id", off.alias("off")).select("vec_id", exact.try_cast("long").alias("deviation"),
                                                                              F.transform("off", lambda c: c.cast("double") / n).alias("centred"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_matrix(centred, "row_no", "centred", dims)
    covariance = gram(blocks, parts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    k = min(components, dims)
    told = values[:k] > max(trace, 0) * dims * np.finfo(float).eps
    matrix = np.where(told, vectors[:, :k] / np.sqrt(np.where(told, values[:k], 1)), 0)
    projected = callMLlibFunc("getIndexedRows", times(spark, blocks, matrix).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = cut_lineage(projected.select(F.col("index").alias("row_no"), vector_to_array("vector").alias("w")))
    error = 0.0
    if told.any():
        again = gram(block_matrix(projected, "row_no", "w", k), parts)[:k, :k] / n
        error = float(np.abs(again - np.eye(k))[np.ix_(told, told)].max())
    share = F.array(*[F.lit(float(e / trace)) if t else F.lit(0.0) for e, t in zip(values[:k], told)])
    has = F.array(*[F.lit(bool(t)) for t in told])
    out = centred.select("row_no", "vec_id", "deviation").join(projected, "row_no").select("vec_id", "deviation", F.posexplode("w").alias("c", "value"))
    return out.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.get(has, F.col("c")), F.col("value")).alias("whitened"),
                      F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))

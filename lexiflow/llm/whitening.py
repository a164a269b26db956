"""Embedding whitening on distributed block matrices.

Centred rows become an MLlib ``BlockMatrix``; its transpose times itself is the scatter
matrix, which is small and decomposed on the driver; the block matrix times the whitening
matrix projects all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import finite_vector, stored

#: Eigenvalues below this share of the largest one count as zero: nothing to scale up there.
RANK_SHARE = 1e-10
#: Entries of the integer vectors stay within this size, in which doubles are exact.
ENTRY_BOUND = float(1 << 52)
#: Rows of a block: at least, at most.
BLOCK_ROWS = (1 << 10, 1 << 16)
_ROW_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


@dataclass
class Whitening:
    """What a fit learned: the fit list's length and sums, all eigenvalues by falling size, the
    (dimensions x components) matrix and the largest entry of (covariance of the whitened fit list - identity)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    matrix: np.ndarray
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) for e in self.eigenvalues[:self.matrix.shape[1]] / self.eigenvalues.sum()]


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(id_col, x, index): x = floor(scale * entry) + shift as long, of the rows without NULL or non-finite
    entries; shorter vectors are filled up with entries of zero; ``index`` is dense from 0.  Written once."""
    entry = lambda c: (F.floor(F.greatest(F.lit(-ENTRY_BOUND), F.least(F.lit(ENTRY_BOUND), scale * c.cast("double")))) + shift).cast("long")
    rows = vectors.where(finite_vector(F.col(vec_col))).select(F.col(id_col), F.transform(vec_col, entry).alias("x"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    per = rows.groupBy(F.shiftright("rid", _ROW_BITS).alias("pid")).agg(F.count(F.lit(1)).alias("c"))
    # One row per partition of the scan: the running sum and the broadcast are bounded by their number.
    offsets = per.select("pid", (F.sum("c").over(Window.orderBy("pid")) - F.col("c")).alias("off"))
    rows = rows.join(F.broadcast(offsets), F.shiftright("rid", _ROW_BITS) == F.col("pid"))
    padded = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(longest) - F.size("x")))
    return rows.select(id_col, padded.alias("x"), (F.col("off") + F.expr(f"rid & {(1 << _ROW_BITS) - 1}L")).alias("index"))


def _scaled_off(n: int, sums: list[int]) -> Column:
    """n * x - S per entry: exact."""
    return F.expr(f"zip_with(x, array({', '.join(f'{s}L' for s in sums)}), (v, s) -> {n}L * v - s)")


def block_matrix(rows: DataFrame, n: int, sums: list[int], total: int) -> BlockMatrix:
    """The rows (x, index) less the mean of the fit list, as blocks of all columns.

    A block is one group of neighbouring indexes; indexes that ``rows`` lacks are lines of zeros.  The blocks are kept
    in executor memory or on disk and are made again from ``rows`` where they get lost; ``release`` lets them go."""
    height, s = int(min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], total // 50_000))), np.array(sums, dtype=np.int64)

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        block = int(b["block"].iloc[0])
        lines = np.zeros((min(height, total - block * height), len(s)))
        lines[b["index"].to_numpy(np.int64) - block * height] = (n * np.stack(b["x"].to_numpy()) - s) / n  # the difference is exact
        return pd.DataFrame({"block": [block], "lines": [len(lines)], "entries": [lines.tobytes(order="F")]})

    blocks = rows.select(F.floor(F.col("index") / height).cast("long").alias("block"), "index", "x").groupBy("block")
    blocks = blocks.applyInPandas(pack, "block long, lines int, entries binary")
    matrices = blocks.rdd.map(lambda r: ((r["block"], 0), DenseMatrix(r["lines"], len(sums), np.frombuffer(r["entries"]))))
    return BlockMatrix(matrices, height, len(sums), total, len(sums)).persist(StorageLevel.MEMORY_AND_DISK)


def release(a: BlockMatrix) -> None:
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def gram(a: BlockMatrix, splits: int) -> np.ndarray:
    """a^T a.  The sum over row blocks is dealt over ``splits`` tasks, which send on one small matrix each."""
    t, b = a.transpose()._java_matrix_wrapper._java_model, a._java_matrix_wrapper._java_model
    out = BlockMatrix(t.multiply(b, splits), a.colsPerBlock, a.colsPerBlock)
    return out.toLocalMatrix().toArray()


def _small(spark, m: np.ndarray) -> BlockMatrix:
    block = DenseMatrix(m.shape[0], m.shape[1], m.flatten(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), m.shape[0], m.shape[1], m.shape[0], m.shape[1])


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """From ``integer_rows``; each distinct vector counts once.  None without a direction of positive variance."""
    spark = rows.sparkSession
    fit = stored(rows.groupBy("x").agg(F.min("index").alias("index")), "fit-list")
    d = (rows.select(F.size("x")).first() or [0])[0]
    if not d:
        return None
    first = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    n, sums = first["n"], [int(first[f"s{i}"]) for i in range(d)]
    splits = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows of repeats are missing here: their lines of the matrix are zero and add nothing.
    blocks = block_matrix(fit, n, sums, rows.count())
    values, vectors = np.linalg.eigh(gram(blocks, splits) / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(components, int((values > values[0] * RANK_SHARE).sum()))
    if not k:
        release(blocks)
        return None
    matrix = np.ascontiguousarray(vectors[:, :k] / np.sqrt(values[:k]))
    white = blocks.multiply(_small(spark, matrix))
    error = float(np.abs(gram(white, splits) / n - np.eye(k)).max())
    release(blocks)
    return Whitening(n, sums, values, matrix, error)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0,
           shift: int = 1_000_000) -> DataFrame:
    """(id_col, component from 1, n, deviation, whitened, explained, identity_error) per remaining row and component.

    Rows with a NULL vector or a NULL or non-finite entry are dropped.  An entry c becomes the long
    x = floor(scale * c) + shift.  The fit list holds each distinct x vector once; its mean centres all
    rows and its covariance gives the components, by falling eigenvalue, at most ``components``.
    deviation is the exact sum over dimensions of (n * x - S)^2; NULL where it exceeds a long.

    NULL and repeated ids are rows like others; repeated vectors count once in the fit.  Vectors shorter than the
    longest one are filled up with zeros.  Directions without variance are no components, so equal rows only,
    a single row, empty vectors or an empty table give no rows.  Other columns are not read."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vec_col, scale, shift)
    model = fit_whitening(rows, components)
    if model is None:
        return rows.limit(0).select(id_col, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                                    *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    total = rows.count()
    white = block_matrix(rows, model.n, model.sums, total).multiply(_small(spark, model.matrix)).toIndexedRowMatrix()
    placed = callMLlibFunc("getIndexedRows", white._java_matrix_wrapper._java_model)
    placed = placed.select(F.col("index").alias("__at"), vector_to_array("vector").alias("__white"))
    # Squares stay in longs where the size of the entries proves it, and in decimals elsewhere.
    far = rows.agg(F.max(F.array_max(F.transform(_scaled_off(model.n, model.sums), F.abs)))).first()[0]
    kind = "long" if far * far * len(model.sums) < 1 << 63 else "decimal(38,0)"
    squares = F.transform(_scaled_off(model.n, model.sums), lambda v: v.cast(kind) * v.cast(kind))
    sum_of = F.aggregate(squares, F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind))
    out = rows.select(F.col("index").alias("__index"), id_col, sum_of.try_cast("long").alias("deviation")).join(placed, F.col("__index") == F.col("__at"))
    explained = F.array(*[F.lit(e) for e in model.explained])
    return out.select(id_col, "deviation", F.posexplode("__white").alias("__i", "whitened")).select(
        id_col, (F.col("__i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("__i") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))

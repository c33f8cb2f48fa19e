"""Whitening of embeddings on distributed block matrices.

Vectors become whole numbers, ``x = floor(256 * component)``. Mean and covariance are those
of the distinct x vectors, each taken once. Their centred rows are indexed
without gaps and cut into blocks of ``BLOCK_ROWS`` rows (``BlockMatrix``); the transpose times
itself gives the scatter matrix, with the middle dimension split, so that partial
products meet and not rows. The driver decomposes that one matrix of dimensions
squared, and a block product with the whitening matrix projects the rows.

Vectors that are null or hold null or non-finite components are left out. Shorter
vectors count as filled up with zeros. Components without variance (fewer
distinct vectors than dimensions, say) have no whitened values and are left
out, so there may be fewer rows than components asked for; a table without
any has none. Repeated rows give repeated rows, ties in eigenvalues keep an
arbitrary basis, the same for all rows. A squared deviation beyond a long is null.
Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored

SCALE = 256.0
COMPONENTS = 4
BLOCK_ROWS = 1024
# Variance below this share of the largest is none.
NOTHING = 1e-12


@dataclass
class Whitening:
    n: int
    sums: list[int | None]
    mean: np.ndarray
    eigenvalues: np.ndarray  # falling
    matrix: np.ndarray  # (dimensions, components): eigenvectors over the roots of their eigenvalues
    trace: float
    identity_error: float = 0.0


def whole_numbers(vector: Column, width: int) -> Column:
    """The x vector, filled up to ``width``."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(vector)))


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored, with a column ``at``: 0, 1, 2, ... without gaps.

    Places within a partition come from Spark, the first place of every
    partition from one count each."""
    found = stored(rows, name)
    numbered = found.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    counts = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}  # one row per partition
    first, at = [], 0
    for part in sorted(counts):
        first.append((part, at - (part << 33)))
        at += counts[part]
    offsets = found.sparkSession.createDataFrame(first, "_part int, _first long")
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("at", F.col("_id") + F.col("_first"))
    return stored(placed.select(*found.columns, "at"), f"{name}-indexed")


def block_matrix(rows: DataFrame, mean: np.ndarray, n: int) -> BlockMatrix:
    """The centred rows of ``at, x`` in distributed blocks, kept: every product reads them several times."""
    center = F.array(*[F.lit(float(m)) for m in mean])
    centred = F.zip_with(F.col("x"), center, lambda a, m: a.cast("double") - m)
    vectors = rows.select("at", array_to_vector(centred).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    blocks = IndexedRowMatrix(vectors, n, len(mean)).toBlockMatrix(BLOCK_ROWS, max(1, len(mean)))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the blocks; one split of the middle dimension per few blocks."""
    splits = max(1, min(blocks.numRowBlocks, 4 * blocks.blocks.getNumPartitions()))
    turned = blocks.transpose()
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def projected(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``at`` and ``y``: the rows of ``blocks`` times ``matrix``."""
    context = blocks.blocks.context
    local = DenseMatrix(*matrix.shape, matrix.T.ravel().tolist())
    right = BlockMatrix(context.parallelize([((0, 0), local)], 1), max(1, matrix.shape[0]), max(1, matrix.shape[1]))
    product = blocks.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("at"), vector_to_array("vector").alias("y"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Mean, spectrum and whitening matrix of the distinct vectors of ``rows.x``."""
    distinct = indexed(rows.select("x").distinct(), "whitening-fit")
    n = distinct.count()
    entry = distinct.select(F.posexplode("x").alias("pos", "v"))
    found = entry.groupBy("pos").agg(F.try_sum("v").alias("s"), F.avg("v").alias("m")).orderBy("pos").collect()  # one row per dimension
    if not found:
        return None
    mean = np.array([r["m"] if r["s"] is None else r["s"] / n for r in found])
    blocks = block_matrix(distinct, mean, n)
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values[:components]
    able = int((some > NOTHING * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    matrix = (vectors * turn)[:, :able] / np.sqrt(values[:able])
    result = Whitening(n, [r["s"] for r in found], mean, values[:able], matrix, float(np.trace(covariance)))
    if able:
        y = stored(projected(blocks, matrix), "whitening-projected")
        result.identity_error = _identity_error(y, able)
    return result


def _identity_error(y: DataFrame, k: int) -> float:
    """The largest entry of the covariance of ``y`` minus the identity, centred by its own mean."""
    means = y.agg(*[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(k)]).first()
    part = [F.col("y")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = y.agg(*[F.avg(part[i] * part[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[p] - (i == j)) for p, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """Usable rows of ``vectors`` with a struct ``d_white``: ``x``, ``deviation`` and ``whitened``; and the fit.

    The columns of ``vectors`` come as ``d_...``, so that none clashes."""
    rows = vectors.filter(usable(vector))
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    rows = rows.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in vectors.columns], whole_numbers(F.col(vector), width).alias("x"))
    rows = indexed(rows, "whitening-rows")
    found = fit(rows, components)
    if found is None or not len(found.eigenvalues):
        return rows.limit(0).withColumn("deviation", F.lit(None).cast("long")).withColumn("y", F.array().cast("array<double>")), found
    blocks = block_matrix(rows, found.mean, rows.count())
    sums = F.array(*[F.lit(s).cast("long") for s in found.sums])
    away = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(found.n).cast("long")), s))
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda acc, d: F.try_add(acc, F.try_multiply(d, d)))
    # Indices are unique, so no key of this join is hot.
    return rows.withColumn("deviation", deviation).join(projected(blocks, found.matrix), "at"), found


def digest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component."""
    rows, found = whiten(vectors.select(key, vector), COMPONENTS, vector)
    values = found.eigenvalues / found.trace if found is not None and found.trace > 0 else []
    explained = F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")
    return rows.select(f"d_{key}", "deviation", F.posexplode("y").alias("pos", "whitened")).select(
        F.col(f"d_{key}").alias(key),
        (F.col("pos") + 1).alias("component"),
        F.lit(found.n if found else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "pos").alias("explained"),
        F.lit(float(found.identity_error) if found else 0.0).alias("identity_error"),
    )

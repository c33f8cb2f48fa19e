"""Approximate nearest neighbours by cosine: inverted lists, adaptive dimensions.

The index rotates unit vectors by a random orthogonal matrix and files each under
its nearest of ``LISTS`` centroids, fitted on at most ``FIT_ROWS`` vectors drawn by
hash; every vector is filed. A query probes the lists nearest to it. Within a
list, distances grow column block by column block: after t of d dimensions the
distance is estimated as d / t times the partial one, and a candidate is
abandoned when the estimate exceeds the query's k-th best distance so far by
more than 1 + ``EPSILON`` / sqrt(t), the bound of a hypothesis test for random
rotations. What is left is scored with the original vectors in double precision.

Queries are broadcast in blocks of ``BLOCK_QUERIES``; the stored vectors aren't
moved for a search, and a task keeps k rows per query, so a list with a third
of all vectors is searched by many tasks. Lists are laid out by range of list
and id, which splits such a list.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than the most frequent one. Ties go to the
smaller id. Rows with equal ids are vectors of their own, but a query never finds
a row with its own id. With fewer than k candidates all probed ones are returned.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stored

K = 5
FIT_ROWS = 20_000
FIT_ROUNDS = 8
LIST_ROWS = 256
MAX_LISTS = 4_096
PROBE_SHARE = 0.65
COLUMNS = 16
EPSILON = 2.1
SLACK = 1e-9  # of squared distances, for rounding
BLOCK_QUERIES = 4_096
ROWS_AT_ONCE = 2_048
SEED = 5


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither over- nor underflow
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(SEED)
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(FIT_ROUNDS):
        of = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


class Index:
    """The stored vectors by list, the centroids and the rotation."""

    def __init__(self, rows: DataFrame, centers: np.ndarray, turn: np.ndarray):
        self.rows, self.centers, self.turn = rows, centers, turn

    @property
    def dim(self) -> int:
        return self.turn.shape[0]


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> Index | None:
    """File every usable vector; None if there is none."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    dim, n = sizes["d"], sizes["count"]
    rows = rows.filter(F.size("v") == dim).withColumn("v", F.col("v").cast("array<double>"))
    drawn = rows.orderBy(F.xxhash64("key", "v")).limit(FIT_ROWS).select("v").toPandas()  # a bounded sample
    sample = unit(np.array(drawn["v"].tolist(), dtype=np.float64))
    lists = min(lists or max(1, math.ceil(n / LIST_ROWS)), MAX_LISTS, max(1, len(sample) // 8))
    turn = rotation(dim)
    centers = fit(sample, lists) @ turn

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1), dim)) @ turn
            of = (x @ centers.T).argmax(axis=1)
            turned = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of), turned], ["key", "v", "list", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    filed = rows.mapInArrow(file, f"key {kind}, v array<double>, list long, x binary")
    return Index(stored(filed.repartitionByRange("list", "key").sortWithinPartitions("list"), "vectors"), centers, turn)


def scan_list(x: np.ndarray, q: np.ndarray, kth: np.ndarray, columns: int = COLUMNS,
              epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of q) that no test has abandoned. ``kth`` holds the
    squared distance that each query has to beat. Every test leaves ties and
    rounding to the exact score."""
    dim = x.shape[1]
    far = np.zeros((len(x), len(q)))
    open_ = np.ones(far.shape, dtype=bool)
    i = j = None
    for at in range(0, dim, columns):
        end = min(dim, at + columns)
        a, b = x[:, at:end], q[:, at:end]
        if i is None:
            far += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            bound = kth[None, :]
        else:
            part = a[i] - b[j]
            far += (part * part).sum(axis=1)
            bound = kth[j]
        if end < dim:
            limit = (1 + epsilon / math.sqrt(end)) ** 2
            keep = far * (dim / end) <= limit * bound + SLACK
        else:
            keep = far <= bound + SLACK
        if i is None:
            open_ = keep
            if end == dim or keep.mean() < 0.25:  # few are left: go on pair by pair
                i, j = np.nonzero(open_)
                far = far[i, j]
        else:
            i, j, far = i[keep], j[keep], far[keep]
    return i, j


def _best(of: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k per query, by score and then key."""
    order = np.lexsort((key, -score, of))
    of = of[order]
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, int)
    rank = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    return order[rank < k]


def search(index: Index, queries: DataFrame, k: int = K, probe_share: float = PROBE_SHARE,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(key, vector)``."""
    spark, dim, centers, turn = index.rows.sparkSession, index.dim, index.centers, index.turn
    probes = max(1, math.ceil(probe_share * len(centers)))
    asked = queries.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(usable("v") & (F.size("v") == dim))
    asked = asked.filter(F.col("key").isNotNull())
    schema = "query_id long, vec_id long, score double"

    def scan_for(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(
            (np.array([r["key"] for r in block]), np.array([list(r["v"]) for r in block], dtype=np.float64))
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, original = shared.value
            flat = unit(original)
            q = flat @ turn
            nearest = np.argpartition(-(q @ centers.T), probes - 1, axis=1)[:, :probes]
            asks = np.zeros((len(q), len(centers)), dtype=bool)
            asks[np.arange(len(q))[:, None], nearest] = True
            kth = np.full(len(q), 8.0)
            none = np.empty(0, dtype=np.int64)
            of, key, score = none, none, np.empty(0)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    keys = batch.column(0).to_numpy(zero_copy_only=False)
                    v = unit(matrix(batch.column(1), dim))
                    lists = batch.column(2).to_numpy()
                    x = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(-1, dim)
                    for one in np.unique(lists):
                        rows, who = np.flatnonzero(lists == one), np.flatnonzero(asks[:, one])
                        if not len(who):
                            continue
                        i, j = scan_list(x[rows], q[who], kth[who])
                        i, j = rows[i], who[j]
                        other = keys[i] != ids[j]
                        i, j = i[other], j[other]
                        exact = (v[i] * flat[j]).sum(axis=1)
                        of, key = np.concatenate([of, j]), np.concatenate([key, keys[i]])
                        score = np.concatenate([score, exact])
                        best = _best(of, key, score, k)
                        of, key, score = of[best], key[best], score[best]
                        count = np.bincount(of, minlength=len(q))
                        worst = np.full(len(q), np.inf)
                        np.minimum.at(worst, of, score)
                        kth = np.where(count == k, 2 - 2 * worst, 8.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(key), pa.array(score)], ["query_id", "vec_id", "score"]
            )

        return index.rows.filter("key is not null").mapInArrow(scan, schema)

    found, block = None, []
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_QUERIES:
            part, block = scan_for(block), []
            found = part if found is None else found.union(part)
    if block:
        found = scan_for(block) if found is None else found.union(scan_for(block))
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Build the index over ``vectors`` and search it for ``queries``."""
    index = build(vectors, key, vector)
    if index is None:
        empty = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)
    return search(index, queries, k, key=key, vector=vector)

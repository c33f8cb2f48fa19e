"""Exact cosine top-k for a table of query vectors.

A block of queries is one matrix. Every task streams its vectors through it in
Arrow batches, by the value of a filter that all of them set, and keeps k rows per query, so what leaves a task is k rows per
query and never a pair per (query, chunk). Blocks of queries, bounded in bytes,
are broadcast one after another; the vectors are scanned for each and never
moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gleaner.operators import ranking as R
from gleaner.schemas import CHUNK_KEY, FILTERS, SECTION_HINT

# Bytes of queries in one broadcast.
BLOCK_BYTES = 32 << 20
# Elements of one score matrix (8 bytes each).
SCORE_CELLS = 8_000_000


def _unit(vectors) -> np.ndarray:
    matrix = np.asarray(list(vectors), dtype=np.float64)
    if matrix.size == 0:
        return matrix.reshape(0, 0)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _allowed(rows: pd.DataFrame, queries: pd.DataFrame, filters: dict[str, str]) -> np.ndarray | None:
    """Boolean matrix rows x queries, or None when no query sets a filter."""
    allowed = None
    for column, wanted in filters.items():
        values = queries[wanted].map(lambda v: None if v is None or pd.isna(v) or v == "" else v)
        if values.isna().all():
            continue
        known = pd.Index(values.dropna().unique())
        row_codes = known.get_indexer(rows[column])
        query_codes = known.get_indexer(values)
        unset = values.isna().to_numpy()
        match = (row_codes[:, None] == query_codes[None, :]) | unset[None, :]
        allowed = match if allowed is None else allowed & match
    return allowed


def _best(found: pd.DataFrame, k: int, order: list[str]) -> pd.DataFrame:
    """First k rows per query by score, ties by the order columns."""
    found = found.assign(_tie=-found["score"].round(9))
    found = found.sort_values(["_q", "_tie", *order], kind="stable")
    return found[found.groupby("_q").cumcount() < k].drop(columns="_tie")


def _split(queries: pd.DataFrame, filters: dict[str, str]) -> tuple[str | None, dict]:
    """A column that every query filters by, and the places of the queries by its value."""
    for column, wanted in filters.items():
        values = queries[wanted].replace("", None)
        if not values.isna().any():
            return column, values.groupby(values).indices
    return None, {}


def _block_top_k(batches: Iterator[pd.DataFrame], queries: pd.DataFrame, vector: str, k: int,
                 order: list[str], filters: dict[str, str]) -> pd.DataFrame | None:
    """Rows meet only queries that may want them, and are kept only if they reach the
    k-th best score their query has so far."""
    if not len(queries):
        return None
    matrix = _unit(queries["vector"])
    column, by_value = _split(queries, filters)
    kth = np.full(len(queries), -np.inf)
    best = None
    for batch in batches:
        parts = [(np.arange(len(batch)), np.arange(len(queries)))]
        if column is not None:
            places = batch.groupby(column).indices
            parts = [(places[value], own) for value, own in by_value.items() if value in places]
        for at, own in parts:
            asked, asked_matrix = queries.iloc[own], matrix[own].T
            step = max(1, SCORE_CELLS // len(own))
            for start in range(0, len(at), step):
                rows = batch.iloc[at[start : start + step]].reset_index(drop=True)
                scores = _unit(rows[vector]) @ asked_matrix
                allowed = _allowed(rows, asked, filters)
                ranked = np.round(scores, 9)
                if allowed is not None:
                    ranked = np.where(allowed, ranked, -np.inf)
                keep = (ranked > -np.inf) & (ranked >= kth[own])
                many = np.flatnonzero(keep.sum(axis=0) > k)
                if len(many):
                    among = ranked[:, many]
                    keep[:, many] &= among >= np.partition(among, len(rows) - k, axis=0)[len(rows) - k]
                r, q = np.nonzero(keep)
                if not len(r):
                    continue
                found = rows.iloc[r][order].reset_index(drop=True).assign(score=scores[r, q], _q=own[q])
                best = _best(found if best is None else pd.concat([best, found]), k, order)
                last = best[best.groupby("_q").cumcount() == k - 1]
                kth[last["_q"].to_numpy()] = last["score"].round(9).to_numpy()
    if best is None or best.empty:
        return None
    return best.assign(query_id=queries["query_id"].to_numpy()[best["_q"].to_numpy()])


def _result_schema(vectors: DataFrame, queries: DataFrame, order: list[str]) -> StructType:
    fields = [queries.schema["query_id"], *[vectors.schema[c] for c in order]]
    return StructType([StructField(f.name, f.dataType) for f in fields]).add("score", "double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    order: list[str],
    vector: str = "embedding",
    filters: dict[str, str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, int]:
    """Ranked ``query_id, *order, score, rank`` and the number of queries.

    ``queries`` holds ``query_id``, ``vector`` and the filter columns; ``order``
    identifies a row of ``vectors`` and breaks ties. ``filters`` maps columns
    of ``vectors`` to filter columns of ``queries``.
    """
    filters = {c: f for c, f in (filters or {}).items() if f in queries.columns}
    queries = queries.select("query_id", "vector", *filters.values())
    vectors = vectors.select(*dict.fromkeys([*order, *filters]), F.col(vector).alias("embedding"))
    schema = _result_schema(vectors, queries, order)
    columns = schema.fieldNames()
    context = vectors.sparkSession.sparkContext

    def scan_for(rows: list) -> DataFrame:
        shared = context.broadcast(pd.DataFrame.from_records(rows, columns=queries.columns))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _block_top_k(batches, shared.value, "embedding", k, order, filters)
            if best is not None:
                yield best[columns]

        return vectors.mapInPandas(scan, schema)

    found, rows, size, n_queries = [], [], 0, 0
    for row in queries.toLocalIterator():
        rows.append(row)
        size += 8 * len(row["vector"] or ()) + 64
        n_queries += 1
        if size >= block_bytes:
            found.append(scan_for(rows))
            rows, size = [], 0
    if rows or not found:
        found.append(scan_for(rows))
    return R.top_k(reduce(DataFrame.unionByName, found), k, order), n_queries


def retriever(points: DataFrame, embed: Callable[[Column], Column], vector: str = "embedding"):
    """``search(queries, k)`` over embedded chunks.

    Three times k rows are fetched when queries carry section hints; the hint
    then prefers among those, for the queries that set one."""

    def run(queries: DataFrame, k: int = R.TOP_K) -> DataFrame:
        hinted = SECTION_HINT in queries.columns
        fetch = k * R.SECTION_OVERFETCH if hinted else k
        asked = queries.withColumn("vector", embed(F.col("query")))
        found, n = nearest(points, asked, fetch, CHUNK_KEY, vector, FILTERS)
        hits = R.attach_chunks(found, points.drop(vector), n * fetch)
        if not hinted:
            return hits
        hints = queries.select("query_id", SECTION_HINT)
        return R.apply_section_hint(hits.join(R.small(hints, n), "query_id"), k).drop(SECTION_HINT)

    return run

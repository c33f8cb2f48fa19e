"""Rerankers over short candidate lists ``(query_id, rank, score, chunk columns)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import ranking as R
from gleaner.operators.fusion import Retriever

# Candidates fetched, results kept and characters shown of a passage.
CANDIDATES = 20
KEPT = 5
PASSAGE_CHARS = 1000

Reranker = Callable[..., DataFrame]


def _rescored(hits: DataFrame, queries: DataFrame, score: Column, k: int) -> DataFrame:
    asked = queries.select("query_id", F.col("query").alias("_query"))
    scored = hits.join(asked, "query_id").withColumn("score", score.cast("double"))
    ranked = R.rerank_rows(scored, [F.col("score").desc(), F.col("rank")])
    return ranked.filter(F.col("rank") <= k).drop("_query")


def lexical_rerank(hits: DataFrame, queries: DataFrame, k: int = KEPT) -> DataFrame:
    """Share of the query's distinct tokens found in the text; ties keep the old order."""
    return _rescored(hits, queries, T.token_overlap(F.col("_query"), F.col("text")), k)


def pair_rerank(scorer: Callable[[Column, Column], Column] | None, fallback: Reranker = lexical_rerank) -> Reranker:
    """Order by ``scorer(query, text)``, e.g. an Arrow-batched model; without one, fall back."""
    if scorer is None:
        return fallback

    def run(hits: DataFrame, queries: DataFrame, k: int = KEPT) -> DataFrame:
        return _rescored(hits, queries, scorer(F.col("_query"), F.col("text")), k)

    return run


def rerank_prompts(hits: DataFrame, passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """One numbered line per candidate, joined per query in rank order."""
    line = F.concat(
        (F.col("rank") - 1).cast("string"), F.lit(". "), "title", F.lit(" / "), "section", F.lit(": "),
        F.substring("text", 1, passage_chars),
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("passages")
    )


def _as_index(item: Column) -> Column:
    """An order item as an integer: numbers are truncated, digit strings are read,
    anything else is NULL."""
    kind = F.schema_of_variant(item)
    text = F.try_variant_get(item, "$", "string")
    return (
        F.when(kind == "STRING", F.when(T.strip(text).rlike("^[+-]?[0-9]+$"), T.strip(text).try_cast("long")))
        .when(kind == "BOOLEAN", F.try_variant_get(item, "$", "boolean").cast("long"))
        .when(kind == "VOID", F.lit(None).cast("long"))
        .otherwise(F.try_variant_get(item, "$", "double").try_cast("long"))
    )


def parsed_order(response: Column) -> Column:
    """Candidate indices from ``{"order": [...]}`` or a bare list.

    NULL when it is no list or when any item is not a number; indices keep
    their first occurrence.
    """
    payload = F.try_parse_json(response)
    listed = F.coalesce(
        F.try_variant_get(payload, "$.order", "array<variant>"),
        F.try_variant_get(payload, "$", "array<variant>"),
    )
    indices = F.transform(listed, _as_index)
    return F.when(~F.exists(indices, lambda i: i.isNull()), F.array_distinct(indices))


def listwise_rerank(hits: DataFrame, queries: DataFrame, responses: DataFrame, k: int = KEPT) -> DataFrame:
    """Apply the order a listwise model answered, ``responses(query_id, response)``.

    Candidates that were not listed follow in their old order; the score counts
    down from the pool size. Unusable answers fall back to the lexical reranker.
    """
    asked = queries.select("query_id", F.col("query").alias("_query")).join(
        responses.select("query_id", parsed_order(F.col("response")).alias("_order")), "query_id", "left"
    )
    pool = hits.withColumn("_n", F.count("*").over(R.W.partitionBy("query_id"))).join(asked, "query_id")
    valid = F.filter("_order", lambda i: (i >= 0) & (i < F.col("_n")))
    usable = F.coalesce(F.size(valid) > 0, F.lit(False))
    at = F.when(usable, F.nullif(F.array_position(valid, (F.col("rank") - 1).cast("long")), F.lit(0)))
    overlap = F.when(~usable, T.token_overlap(F.col("_query"), F.col("text")).cast("double"))
    placed = pool.withColumns({"_at": at, "_overlap": overlap, "_usable": usable})
    ordered = R.rerank_rows(placed, [F.col("_at").asc_nulls_last(), F.col("_overlap").desc_nulls_last(), F.col("rank")])
    counted = F.when(F.col("_usable"), (F.col("_n") - F.col("rank") + 1).cast("double")).otherwise(F.col("_overlap"))
    return (
        ordered.filter(F.col("rank") <= k)
        .withColumn("score", counted)
        .drop("_n", "_order", "_query", "_at", "_overlap", "_usable")
    )


def rerank_retriever(
    search: Retriever, rerank: Reranker = lexical_rerank, candidates: int = CANDIDATES
) -> Retriever:
    """Fetch a pool, rerank it, keep the best."""

    def run(queries: DataFrame, k: int = KEPT) -> DataFrame:
        return rerank(search(queries, candidates), queries, k)

    return run

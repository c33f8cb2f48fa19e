"""The whole way from a table of questions to a table of answers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import answers as A
from gleaner.operators import questions as Q
from gleaner.operators import ranking as R
from gleaner.operators.catalog import Catalog
from gleaner.operators.evidence import verdicts
from gleaner.operators.fusion import Retriever, multi_query_search
from gleaner.schemas import FILTER_COLUMNS, SECTION_HINT
from gleaner.session import cut_lineage


class Corrected(NamedTuple):
    hits: DataFrame  # final rows per question
    outcome: DataFrame  # the question rows with verdict, retried, retry_queries, final filters
    attempts: DataFrame  # ids, scores and verdict of every attempt


def _sub_queries(prepared: DataFrame, queries: str) -> DataFrame:
    filters = [c for c in FILTER_COLUMNS if c in prepared.columns]
    return prepared.select(
        "query_id", *filters, F.size(queries).alias("n_subs"), F.posexplode(queries).alias("sub_no", "query")
    )


def _attempt(no: int, prepared: DataFrame, queries: str, hits: DataFrame, judged: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    listed = hits.groupBy("query_id").agg(ordered.alias("_hits"))
    return (
        prepared.select("query_id", F.col(queries).alias("queries"))
        .join(judged, "query_id")
        .join(listed, "query_id", "left")
        .select(
            "query_id",
            F.lit(no).alias("attempt"),
            "queries",
            F.coalesce(F.transform("_hits", lambda x: x["id"]), F.array().cast("array<string>")).alias("chunk_ids"),
            F.coalesce(F.transform("_hits", lambda x: x["score"]), F.array().cast("array<double>")).alias("scores"),
            "sufficient",
            "reason",
            "overlap",
        )
    )


def retrieve_with_correction(
    prepared: DataFrame, search: Retriever, catalog: Catalog, k: int = R.TOP_K
) -> Corrected:
    """Search and check; where evidence is thin, search once more and more broadly.

    The hits of the second pass replace those of the first. Both passes are
    materialized: they are small (k rows per question), the second depends on
    the first, and neither must run twice.
    """
    prepared = cut_lineage(prepared)
    asked = prepared.select("query_id", "query")
    first = cut_lineage(multi_query_search(search, _sub_queries(prepared, "queries"), k))
    judged = cut_lineage(verdicts(asked, first))
    thin = judged.filter("NOT sufficient").select("query_id")
    again = Q.rewrite(prepared.join(thin, "query_id", "left_semi"), catalog, use_kind=False, to="_plain")
    again = again.withColumn(
        "retry_queries",
        Q.follow_up_queries(F.col("query"), F.col("_plain"), F.col("providers"), F.col("queries")),
    ).drop("_plain")
    if SECTION_HINT in again.columns:
        again = again.withColumn(SECTION_HINT, F.lit(None).cast("string"))
    again = cut_lineage(again)
    second = cut_lineage(multi_query_search(search, _sub_queries(again, "retry_queries"), k))
    judged_again = cut_lineage(verdicts(again.select("query_id", "query"), second))

    fine = judged.filter("sufficient")
    kept = prepared.join(fine, "query_id").withColumns(
        {"retried": F.lit(False), "retry_queries": F.array().cast("array<string>")}
    )
    redone = again.join(judged_again, "query_id").withColumn("retried", F.lit(True))
    hits = first.join(fine.select("query_id"), "query_id", "left_semi").unionByName(second)
    attempts = _attempt(1, prepared, "queries", first, judged).unionByName(
        _attempt(2, again, "retry_queries", second, judged_again)
    )
    return Corrected(hits, kept.unionByName(redone), attempts)


def respond(outcome: DataFrame, hits: DataFrame, strategy: str, generate: A.Generator = A.first_sentence) -> DataFrame:
    """Answer, sources, strategy, final filters, preprocessing and evidence per question."""
    verdict = outcome.select("query_id", "sufficient", "reason", "overlap")
    questions = outcome.drop("sufficient", "reason", "overlap")
    filters = [c for c in FILTER_COLUMNS if c in outcome.columns]
    return A.answer_or_abstain(questions, hits, verdict, generate).select(
        "query_id",
        "query",
        "answer",
        "sources",
        F.lit(strategy).alias("strategy"),
        F.struct(*[F.col(c).alias(c.removeprefix("filter_")) for c in filters]).alias("filters"),
        F.struct(
            "kind",
            "rewritten",
            F.concat("queries", "retry_queries").alias("queries"),
            "providers",
            "topics",
            F.col("source").alias("extractor"),
        ).alias("preprocess"),
        F.struct("sufficient", "reason", "overlap", "retried").alias("evidence"),
    )


def answer_questions(
    queries: DataFrame,
    search: Retriever,
    catalog: Catalog,
    strategy: str = "dense",
    extractions: DataFrame | None = None,
    generate: A.Generator = A.first_sentence,
    k: int = R.TOP_K,
) -> DataFrame:
    prepared = Q.preprocess(queries, catalog, extractions)
    corrected = retrieve_with_correction(prepared, search, catalog, k)
    return respond(corrected.outcome, corrected.hits, strategy, generate)


def inspect_preprocess(queries: DataFrame, catalog: Catalog, extractions: DataFrame | None = None) -> DataFrame:
    """What preprocessing makes of each question."""
    rows = Q.preprocess(queries, catalog, extractions)
    return rows.select(
        "query_id", "query", "kind", "source", "providers", "topics", "rewritten", "queries",
        F.struct(*[F.col(c).alias(c.removeprefix("filter_")) for c in FILTER_COLUMNS]).alias("filters"),
    )


def inspect_evidence(responses: DataFrame) -> DataFrame:
    """Answer, abstention and evidence of each question."""
    return responses.select(
        "query_id", "query", "answer", (F.col("answer") == A.ABSTAIN_MESSAGE).alias("abstained"), "evidence"
    )

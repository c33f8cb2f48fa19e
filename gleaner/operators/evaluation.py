"""Retrieval and generation scores, costs and their means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import ranking as R

# Phrases that mark a refusal, and list prices in USD per million tokens.
REFUSAL_MARKERS = (
    "do not know",
    "don't know",
    "does not contain",
    "does not have",
    "not in the",
    "no retrieved context",
    "ambiguous",
    "which provider",
    "which plan",
)
REFUSAL_CATEGORIES = ("unanswerable", "ambiguous")
EMBED_USD = 0.02
PROMPT_USD = 0.40
COMPLETION_USD = 1.60

RETRIEVAL_MEANS = ["recall_at_k", "precision_at_k", "mrr", "ndcg_at_k"]
GENERATION_SCORES = ["faithfulness", "answer_relevance", "context_precision", "context_recall", "groundedness"]
ENGINEERING = [
    "end_to_end_ms",
    "retrieval_ms",
    "reranking_ms",
    "llm_ms",
    "embed_tokens",
    "llm_prompt_tokens",
    "llm_completion_tokens",
    "cost_usd",
]


def document_ranking(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct documents of each ranked list, in first-seen order."""
    by = by or ["query_id"]
    first = hits.groupBy(*by, "document_id").agg(F.min("rank").alias("_first"))
    window = R.W.partitionBy(*by).orderBy("_first")
    return first.withColumn("rank", F.row_number().over(window)).drop("_first")


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def retrieval_scores(ranking: DataFrame, cases: DataFrame, relevant: DataFrame, k: int = R.TOP_K,
                     variants: list[str] | None = None) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG per case.

    ``ranking(query_id, document_id, rank)``, ``cases(query_id, ...)``,
    ``relevant(query_id, document_id)``. Recall and nDCG are NULL where nothing
    is relevant. The reciprocal rank looks at the whole list, the others at k.
    """
    by = [c for c in ("variant", "query_id") if c in ranking.columns]
    wanted = relevant.select("query_id", "document_id").distinct()
    n_relevant = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    within = F.col("rank") <= k
    found = (
        ranking.join(wanted, ["query_id", "document_id"])
        .groupBy(*by)
        .agg(
            F.count_if(within).alias("_hits"),
            F.min("rank").alias("_best"),
            F.sum(F.when(within, _gain(F.col("rank")))).alias("_dcg"),
        )
    )
    every = cases
    if variants is not None:
        every = cases.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    scored = every.join(n_relevant, "query_id", "left").join(found, by, "left")
    n = F.coalesce(F.col("n_relevant"), F.lit(0))
    hits = F.coalesce(F.col("_hits"), F.lit(0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), n), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + _gain(i),
    )
    some = n > 0
    return scored.withColumns(
        {
            "recall_at_k": F.when(some, hits / n),
            "precision_at_k": hits / F.lit(float(k)) if k > 0 else F.lit(0.0),
            "reciprocal_rank": F.coalesce(F.lit(1.0) / F.col("_best"), F.lit(0.0)),
            "ndcg_at_k": F.when(some, F.coalesce(F.col("_dcg"), F.lit(0.0)) / ideal if k > 0 else F.lit(0.0)),
        }
    ).drop("n_relevant", "_hits", "_best", "_dcg")


def _mean(column: Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def retrieval_means(ok: Column | None = None) -> list[Column]:
    """Aggregates for ``mean_retrieval``; rows where ``ok`` is false are left out."""

    def only(name: str) -> Column:
        return F.col(name) if ok is None else F.when(ok, F.col(name))

    return [
        _mean(only("recall_at_k")).alias("recall_at_k"),
        _mean(only("precision_at_k")).alias("precision_at_k"),
        _mean(only("reciprocal_rank")).alias("mrr"),
        _mean(only("ndcg_at_k")).alias("ndcg_at_k"),
    ]


def mean_retrieval(scores: DataFrame, *by: str) -> DataFrame:
    """Recall and nDCG skip cases without relevant documents; the others count them as 0."""
    return scores.groupBy(*by).agg(*retrieval_means())


def looks_like_refusal(answer: Column) -> Column:
    lowered = F.lower(answer)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in REFUSAL_MARKERS])


def generation_scores(answer: Column, context: Column, expected_answer: Column, category: Column) -> dict[str, Column]:
    """Faithfulness, answer relevance and groundedness; precision and recall of the
    context are the retrieval scores of the same case."""
    grounded = F.when(T.is_blank(context), F.lit(0.0)).otherwise(T.token_overlap(answer, context))
    refused = category.isin(*REFUSAL_CATEGORIES) & looks_like_refusal(answer)
    expected = T.blank_to_null(expected_answer)
    score = F.when(refused, F.lit(1.0)).otherwise(grounded)
    return {
        "faithfulness": score,
        "answer_relevance": F.when(expected.isNull(), T.token_overlap(answer, context)).otherwise(
            T.token_overlap(answer, expected)
        ),
        "groundedness": score,
    }


def generation_means(ok: Column | None = None) -> list[Column]:
    return [
        _mean(F.col(c) if ok is None else F.when(ok, F.col(c))).alias(c) for c in GENERATION_SCORES
    ]


def mean_generation(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(*generation_means())


def cost_usd(embed_tokens: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    total = (
        embed_tokens * F.lit(EMBED_USD)
        + prompt_tokens * F.lit(PROMPT_USD)
        + completion_tokens * F.lit(COMPLETION_USD)
    )
    return total / F.lit(1_000_000.0)


def engineering_means() -> list[Column]:
    """Means over all rows, failed ones included, with the error rate and the total cost."""
    return [
        *[_mean(F.col(c)).alias(c) for c in ENGINEERING],
        _mean(F.col("error").isNotNull().cast("double")).alias("error_rate"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd_total"),
    ]


def mean_engineering(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*engineering_means())


def experiment_report(results: DataFrame, *by: str) -> DataFrame:
    """One row per variant: retrieval and generation means over the cases that
    succeeded, engineering means over all of them."""
    ok = F.col("error").isNull()
    generation = [c for c in GENERATION_SCORES if c in results.columns]
    return results.groupBy(*by).agg(
        F.count("*").alias("case_count"),
        *retrieval_means(ok),
        *(generation_means(ok) if len(generation) == len(GENERATION_SCORES) else []),
        *engineering_means(),
    )


def category_report(results: DataFrame, *by: str) -> DataFrame:
    """Retrieval means by category over the cases that succeeded."""
    return results.filter(F.col("error").isNull()).groupBy(*by, "category").agg(*retrieval_means())


def comparison_table(report: DataFrame) -> DataFrame:
    """The printed comparison: one line per variant."""
    return report.select(
        "variant", "recall_at_k", "mrr", "ndcg_at_k", F.col("end_to_end_ms").alias("ms"), "cost_usd_total"
    ).orderBy("variant")


def select_cases(cases: DataFrame, case_id: str | None = None, first: int | None = None) -> DataFrame:
    """One case by id, or the first N in id order."""
    if case_id is not None:
        cases = cases.filter(F.col("id") == case_id)
    return cases if first is None else cases.orderBy("id").limit(first)

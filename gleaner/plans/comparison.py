"""Run cases through several retrievers and report on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gleaner.functions import text as T
from gleaner.operators import answers as A
from gleaner.operators import evaluation as EV
from gleaner.operators import ranking as R
from gleaner.operators.fusion import Retriever
from gleaner.session import cut_lineage

TIMINGS = ["end_to_end_ms", "retrieval_ms", "reranking_ms", "llm_ms"]


def guarded(call: Callable[[str, str], str]) -> A.Generator:
    """A generator whose failures become the ``error`` of their own case.

    Returns ``struct<answer,error>``."""

    def run(questions: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = []
        for question, context in zip(questions, contexts, strict=True):
            try:
                rows.append((call(question, context), None))
            except Exception as error:  # one failing case must not fail the job
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["answer", "error"], dtype=object)

    run.__annotations__ = {"questions": pd.Series, "contexts": pd.Series, "return": pd.DataFrame}
    schema = StructType().add("answer", StringType()).add("error", StringType())
    return lambda question, context: F.pandas_udf(run, schema)(question, context)


def _split(answered: DataFrame) -> DataFrame:
    if isinstance(answered.schema["answer"].dataType, StructType):
        return answered.withColumns({"error": F.col("answer.error"), "answer": F.col("answer.answer")})
    return answered.withColumn("error", F.lit(None).cast("string"))


def run_cases(
    cases: DataFrame,
    searches: dict[str, Retriever] | Callable[[DataFrame, int], dict[str, DataFrame]],
    k: int = R.TOP_K,
    generate: A.Generator | None = A.first_sentence,
    timings: DataFrame | None = None,
    system_prompt: str = A.SYSTEM_PROMPT,
) -> DataFrame:
    """One row per variant and case with all scores.

    ``cases(id, question, expected_documents, expected_answer, category)``.
    The raw question is searched, by each retriever or by one function that
    returns the hits of all variants. ``timings(variant, id, *_ms)`` are measured
    elsewhere: a batch job has no latency per question. A case whose generator
    failed keeps its error and its retrieval scores; those of the answer are neutral.
    """
    asked = cases.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    if callable(searches):
        lists = searches(asked, k)
    else:
        lists = {name: search(asked, k) for name, search in searches.items()}
    named = [rows.withColumn("variant", F.lit(name)) for name, rows in lists.items()]
    hits = cut_lineage(reduce(DataFrame.unionByName, named))
    ranking = EV.document_ranking(hits, ["variant", "query_id"])
    relevant = cases.select(
        F.col("id").alias("query_id"), F.explode("expected_documents").alias("document_id")
    )
    every = cases.withColumnRenamed("id", "query_id").drop("expected_documents")
    scored = EV.retrieval_scores(ranking, every, relevant, k, list(lists))
    documents = F.array_sort(F.collect_list(F.struct("rank", "document_id")))
    listed = ranking.groupBy("variant", "query_id").agg(documents.alias("_ranked"))
    rows = scored.join(listed, ["variant", "query_id"], "left").withColumn(
        "retrieved_documents",
        F.coalesce(F.transform("_ranked", lambda x: x["document_id"]), F.array().cast("array<string>")),
    ).drop("_ranked")
    embed_tokens = T.count_tokens(F.col("question"))
    if generate is None:
        rows = rows.withColumns(
            {
                "answer": F.lit(None).cast("string"),
                "error": F.lit(None).cast("string"),
                "embed_tokens": embed_tokens,
                "llm_prompt_tokens": F.lit(0),
                "llm_completion_tokens": F.lit(0),
            }
        )
    else:
        packed = A.contexts(hits.withColumn("query_id", F.struct("variant", "query_id"))).select(
            "query_id.variant", "query_id.query_id", "context"
        )
        rows = rows.join(packed, ["variant", "query_id"], "left")
        rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
        rows = _split(rows.withColumn("answer", generate(F.col("question"), F.col("context"))))
        prompt = T.count_tokens(A.user_prompt(F.col("question"), F.col("context")))
        said = F.coalesce("answer", F.lit(""))
        rows = rows.withColumns(
            EV.generation_scores(said, F.col("context"), F.col("expected_answer"), F.col("category"))
        ).withColumns(
            {
                "context_precision": F.col("precision_at_k"),
                "context_recall": F.col("recall_at_k"),
                "embed_tokens": embed_tokens,
                "llm_prompt_tokens": prompt + len(system_prompt.split()),
                "llm_completion_tokens": T.count_tokens(F.col("answer")),
            }
        ).drop("context")
        ok = F.col("error").isNull()
        neutral = ["faithfulness", "answer_relevance", "context_precision", "groundedness"]
        rows = rows.withColumns(
            {c: F.when(ok, F.col(c)).otherwise(F.lit(0.0)) for c in neutral}
            | {"context_recall": F.when(ok, F.col("context_recall"))}
        )
    rows = rows.withColumn(
        "cost_usd",
        EV.cost_usd(F.col("embed_tokens"), F.col("llm_prompt_tokens"), F.col("llm_completion_tokens")),
    ).withColumnRenamed("query_id", "id")
    if timings is None:
        return rows.withColumns({c: F.lit(0.0) for c in TIMINGS})
    joined = rows.join(timings.select("variant", "id", *TIMINGS), ["variant", "id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in TIMINGS})


def compare(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report per variant, and retrieval means per variant and category."""
    return EV.experiment_report(results, "variant"), EV.category_report(results, "variant")


def with_run_stamp(report: DataFrame) -> DataFrame:
    """ISO-8601 UTC time of the run."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return report.withColumn("ran_at", stamp)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row."""
    with_run_stamp(report).write.mode("overwrite").json(path)



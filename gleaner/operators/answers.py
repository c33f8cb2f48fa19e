"""Contexts, citations, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

# Texts that stand in for a missing context and for an answer.
NO_CONTEXT = "No retrieved context."
ABSTAIN_MESSAGE = "The knowledge base does not contain enough information to answer this question."
SYSTEM_PROMPT = (
    "Answer only from the passages given. Say that you do not know when they do not hold the answer."
)

SOURCES = "array<struct<title:string,section:string,url:string>>"

Generator = Callable[[Column, Column], Column]


def contexts(hits: DataFrame) -> DataFrame:
    """Numbered passages of each query in rank order; at most k rows meet per query."""
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] Title: "), "title", F.lit(" | Section: "), "section",
        F.coalesce(F.concat(F.lit(" | URL: "), T.blank_to_null(F.col("source_url"))), F.lit("")),
    )
    passage = F.concat(header, F.lit("\n"), T.strip(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["passage"]), "\n\n").alias("context")
    )


def citations(hits: DataFrame) -> DataFrame:
    """Distinct title, section and url of each query, in order of first rank."""
    source = ["title", "section", F.col("source_url").alias("url")]
    first = hits.groupBy("query_id", *source).agg(F.min("rank").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.struct("title", "section", "url").alias("source"))))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda x: x["source"]).alias("sources"))


def user_prompt(question: Column, context: Column) -> Column:
    passages = F.coalesce(T.blank_to_null(T.strip(context)), F.lit(NO_CONTEXT))
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), passages)


def first_sentence(question: Column, context: Column) -> Column:
    """The offline generator: the first sentence of the best passage."""
    best = F.get(F.split(context, r"\n\n\[2\] Title: ", 2), F.lit(0))
    body = F.regexp_replace(best, r"^\[1\][^\n]*\n", "")
    sentence = F.regexp_extract(body, r"(?s)^(.*?[.!?])(?=\s|$)", 1)
    return F.coalesce(T.blank_to_null(sentence), F.get(F.split(body, "\n\n"), F.lit(0)))


def grounded_answers(questions: DataFrame, hits: DataFrame, generate: Generator = first_sentence) -> DataFrame:
    """Add context, answer and sources. Without hits the context is empty."""
    return (
        questions.join(contexts(hits), "query_id", "left")
        .join(citations(hits), "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES)))
        .withColumn("answer", generate(F.col("query"), F.col("context")))
    )


def answer_or_abstain(questions: DataFrame, hits: DataFrame, verdicts: DataFrame,
                      generate: Generator = first_sentence) -> DataFrame:
    """Answers where the evidence suffices; the fixed message without sources elsewhere.

    The generator only ever sees the sufficient rows."""
    judged = questions.join(verdicts, "query_id")
    kept = hits.join(verdicts.filter("sufficient").select("query_id"), "query_id", "left_semi")
    answered = grounded_answers(judged.filter("sufficient"), kept, generate)
    silent = judged.filter("NOT sufficient").withColumns(
        {"context": F.lit(""), "sources": F.array().cast(SOURCES), "answer": F.lit(ABSTAIN_MESSAGE)}
    )
    return answered.unionByName(silent)

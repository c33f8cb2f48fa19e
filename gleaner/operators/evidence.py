"""Does what was found bear on the question?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

# Fixed value: least share of question terms that the passages must contain.
MIN_OVERLAP = 0.3


def evidence_overlap(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``n_hits`` and ``overlap``: the share of question terms found in any hit.

    A question without terms counts as covered. The terms of at most k hits
    meet per question.
    """
    passage = F.concat_ws(" ", "title", "section", "text")
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.array_distinct(F.flatten(F.collect_list(T.content_terms(passage)))).alias("_found"),
    )
    terms = T.content_terms(F.col("query"))
    overlap = F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(
        T.share_of(terms, F.coalesce("_found", F.array().cast("array<string>")))
    )
    joined = questions.join(found, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return joined.withColumn(
        "overlap", F.when(F.col("n_hits") == 0, F.lit(0.0)).otherwise(overlap)
    ).drop("_found")


def _truth(value: Column) -> Column:
    """Whether a JSON value counts as true."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def verdicts(questions: DataFrame, hits: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """``(query_id, sufficient, reason, overlap)`` for every question.

    A column ``answer`` holds verdicts of a model (JSON text); unusable ones
    fall back to the overlap test, and no hits are never sufficient.
    """
    checked = evidence_overlap(questions, hits)
    none = F.col("n_hits") == 0
    low = F.col("overlap") < F.lit(min_overlap)
    sufficient = ~none & ~low
    reason = F.when(none, F.lit("no_hits")).when(low, F.lit("low_overlap")).otherwise(F.lit("ok"))
    if "answer" in questions.columns:
        payload = F.try_parse_json("answer")
        judged = ~none & F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))
        said = F.try_variant_get(payload, "$.reason", "variant")
        text = F.when(_truth(said), F.try_variant_get(said, "$", "string"))
        reason = F.when(judged, F.coalesce(text, F.lit("ok"))).otherwise(reason)
        sufficient = F.when(judged, _truth(F.try_variant_get(payload, "$.sufficient", "variant"))).otherwise(
            sufficient
        )
    return checked.select("query_id", sufficient.alias("sufficient"), reason.alias("reason"), "overlap")

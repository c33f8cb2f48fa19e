"""Stored documents, chunks, parents, trees and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.schemas import CHUNK, DOCUMENT, EVAL_CATEGORIES, NODE, checked
from gleaner.sources.records import read_json

CASE = "id string, question string, expected_documents array<string>, expected_answer string, category string"


def document_name(documents: DataFrame) -> DataFrame:
    """Add ``name``: type, id and slug (or title), joined by hyphens."""
    base = F.coalesce(T.blank_to_null(F.col("slug")), F.col("title")) if "slug" in documents.columns else F.col("title")
    slug = F.lower(F.btrim(F.regexp_replace(base, "[^a-zA-Z0-9_-]+", "-"), F.lit("-")))
    slug = F.coalesce(T.blank_to_null(slug), F.lit("doc"))
    return documents.withColumn("name", F.concat_ws("-", "content_type", "id", slug))


def write_documents(documents: DataFrame, path: str) -> None:
    document_name(documents).write.mode("overwrite").partitionBy("content_type").parquet(path)


def read_documents(
    spark: SparkSession, path: str, document_id: str | None = None, content_type: str | None = None
) -> DataFrame:
    """Documents with their names; the type prunes folders, the id is pushed down."""
    return _only(spark.read.schema(f"{DOCUMENT}, name string").parquet(path), "id", document_id, content_type)


def _only(rows: DataFrame, key: str, document_id: str | None, content_type: str | None) -> DataFrame:
    if content_type is not None:
        rows = rows.filter(F.col("content_type") == content_type)
    return rows if document_id is None else rows.filter(F.col(key) == document_id)


def write_chunks(chunks: DataFrame, path: str, chunker: str, parents: bool = False) -> None:
    """Children and parents go to separate tables; each chunker has its own."""
    kind = "parents" if parents else "chunks"
    chunks.write.mode("overwrite").partitionBy("content_type").parquet(f"{path}/{kind}/{chunker}")


def read_chunks(
    spark: SparkSession,
    path: str,
    chunker: str,
    parents: bool = False,
    document_id: str | None = None,
    content_type: str | None = None,
) -> DataFrame:
    kind = "parents" if parents else "chunks"
    rows = spark.read.schema(CHUNK).parquet(f"{path}/{kind}/{chunker}")
    return _only(rows, "document_id", document_id, content_type)


def write_tree(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation cases from a JSON array or from lines; unknown categories fail."""
    return checked(read_json(spark, path, CASE, lines), "category", EVAL_CATEGORIES)


def categories_present(cases: DataFrame) -> DataFrame:
    return cases.select("category").distinct()

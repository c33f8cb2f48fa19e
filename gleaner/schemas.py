"""Schemas and fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies that records are validated against.
CONTENT_TYPES = ("article", "review", "provider")
STRATEGIES = ("dense", "sparse", "hybrid", "rerank")
QUERY_KINDS = ("factual", "comparison", "recommendation", "pricing", "review", "multi-hop")
EVAL_CATEGORIES = (
    "factual",
    "pricing",
    "features",
    "integrations",
    "comparison",
    "recommendation",
    "multi-hop",
    "ambiguous",
    "unanswerable",
)
CHUNKERS = ("structure_aware", "fixed_size", "parent_child")

SECTION = "struct<heading:string,heading_path:array<string>,text:string>"

RAW_POST = (
    "id string, title string, slug string, html string, content_type string, "
    "provider string, url string, published_at string, updated_at string"
)

DOCUMENT = (
    "id string, title string, content_type string, provider string, url string, "
    f"published_at string, updated_at string, sections array<{SECTION}>"
)

# ``chunk_no`` is the position of a chunk within its document. Together with
# the document it identifies a chunk row even where chunk ids repeat, and it
# gives the corpus order that breaks score ties.
CHUNK_KEY = ["content_type", "document_id", "chunk_no"]

CHUNK_COLUMNS = [
    "content_type",
    "document_id",
    "chunk_no",
    "id",
    "provider",
    "title",
    "section",
    "heading_path",
    "text",
    "source_url",
    "updated_at",
    "parent_id",
]

CHUNK = (
    "content_type string, document_id string, chunk_no int, id string, provider string, "
    "title string, section string, heading_path array<string>, text string, "
    "source_url string, updated_at string, parent_id string"
)

NODE = (
    "id string, level int, node_type string, text string, children array<string>, parent_id string, "
    "document_id string, content_type string, provider string, title string, section string, "
    "heading_path array<string>, source_url string, ord bigint"
)

# Columns of the queries table that restrict a search, by the chunk column they restrict.
FILTERS = {
    "provider": "filter_provider",
    "content_type": "filter_content_type",
    "document_id": "filter_document_id",
}
SECTION_HINT = "filter_section"
FILTER_COLUMNS = [*FILTERS.values(), SECTION_HINT]


def with_filter_columns(queries: DataFrame) -> DataFrame:
    """Add the filter columns that a queries table lacks, as NULL."""
    missing = {c: F.lit(None).cast("string") for c in FILTER_COLUMNS if c not in queries.columns}
    return queries.withColumns(missing) if missing else queries


def require(condition: Column, message: Column | str) -> Column:
    """NULL where ``condition`` holds; fails the job elsewhere."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(text))


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Reject rows whose ``column`` holds a value outside ``allowed``."""
    ok = F.col(column).isin(*allowed)
    message = F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("NULL")))
    return df.withColumn(
        column, F.when(ok, F.col(column)).otherwise(F.raise_error(message).cast("string"))
    )

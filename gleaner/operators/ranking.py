"""Top-k per query, and the size checks that guard broadcasts.

``row_number() <= k`` with a literal ``k`` lets Spark cut every partition to k
rows per query before it shuffles (``WindowGroupLimit``), so a query that
matches a third of the corpus still ships k rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.schemas import CHUNK_KEY, FILTERS, SECTION_HINT
from gleaner.session import cut_lineage

# Default result sizes and over-fetch.
TOP_K = 5
SECTION_OVERFETCH = 3

# Narrow rows (ids, ranks, scores, single terms) that may be broadcast: well
# below 100 MB. Larger sides are shuffled or cut into blocks of this size.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted size allows it."""
    return F.broadcast(df) if rows <= limit else df


def score_order(order: list[str], score: str = "score", digits: int = 9) -> list[Column]:
    """Best score first; scores equal up to summation noise fall back to ``order``."""
    return [F.round(F.col(score), digits).desc(), *[F.col(c) for c in order]]


def top_k(scored: DataFrame, k: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    window = W.partitionBy(*(group or ["query_id"])).orderBy(*score_order(order))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def rerank_rows(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Dense ranks 1..n per query over a ranked list that is already short."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def filter_matches(columns: dict[str, str] = FILTERS, queries: str = "q", chunks: str = "c") -> Column:
    """Every filter that is set equals the chunk's value."""
    condition = F.lit(True)
    for column, wanted in columns.items():
        value = F.nullif(F.col(f"{queries}.{wanted}"), F.lit(""))
        condition = condition & (value.isNull() | (F.col(f"{chunks}.{column}") == value))
    return condition


def headings_of(section: Column, heading_path: Column) -> Column:
    """All headings of a chunk in one lower-cased string, for substring hints."""
    return F.lower(F.array_join(F.concat(F.array(section), heading_path), "\x01"))


def hint_matches(hint: Column, headings: Column) -> Column:
    hint = F.nullif(hint, F.lit(""))
    return F.coalesce(F.contains(headings, F.lower(hint)), F.lit(False)) | hint.isNull()


def matches_section(section: Column, heading_path: Column, hint: Column) -> Column:
    """The hint occurs, ignoring case, in the section or in any heading above it."""
    return hint_matches(hint, headings_of(section, heading_path))


def prefer_matches(hits: DataFrame, matched: str) -> DataFrame:
    """Keep the matched rows of each query, or all its rows when none matched."""
    best = F.max(F.col(matched)).over(W.partitionBy("query_id"))
    return hits.withColumn("_best", best).filter(F.col(matched) == F.col("_best")).drop("_best")


def top_k_preferring(scored: DataFrame, k: int, order: list[str], matched: str) -> DataFrame:
    """First k of the matched rows, or first k of all rows where none matched.

    Both candidate lists are cut to k before a query's rows meet.
    """
    return prefer_matches(top_k(scored, k, order, ["query_id", matched]), matched)


def apply_section_hint(hits: DataFrame, k: int | None = None, hint: str = SECTION_HINT) -> DataFrame:
    """Section hint with fallback over a short ranked list."""
    matched = hits.withColumn(
        "_match", matches_section(F.col("section"), F.col("heading_path"), F.col(hint))
    )
    kept = rerank_rows(prefer_matches(matched, "_match").drop("_match"), [F.col("rank")])
    return kept if k is None else kept.filter(F.col("rank") <= k)


def attach_chunks(hits: DataFrame, chunks: DataFrame, rows: int) -> DataFrame:
    """Join the chunk columns onto narrow hits last, streaming over the chunks.

    Few hits are stored first and cut the chunks to their documents; Spark moves that
    below the chunkers, which then work on documents with hits only."""
    narrow = hits.select("query_id", "rank", "score", *CHUNK_KEY)
    if rows > BROADCAST_ROWS:
        return narrow.join(chunks, CHUNK_KEY)
    narrow = cut_lineage(narrow)
    of = ["content_type", "document_id"]
    found = chunks.join(F.broadcast(narrow.select(*of).distinct()), of, "left_semi")
    return F.broadcast(narrow).join(found, CHUNK_KEY)

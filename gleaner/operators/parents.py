"""Replace child hits by their parent sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import ranking as R
from gleaner.operators.fusion import Retriever
from gleaner.schemas import CHUNK_COLUMNS, CHUNK_KEY
from gleaner.session import cut_lineage


def parent_store(parents: DataFrame) -> DataFrame:
    """One row per parent id; the last in corpus order wins."""
    last = F.max_by(F.struct(*CHUNK_COLUMNS), F.struct(*CHUNK_KEY))
    return parents.groupBy("id").agg(last.alias("_p")).select("_p.*")


def expand_to_parents(hits: DataFrame, parents: DataFrame, rows: int | None = None) -> DataFrame:
    """A hit whose parent exists becomes that parent with the hit's score.

    Siblings collapse to the best one; other hits stay. ``rows`` is the known
    size of ``hits`` and allows to select the parents by a broadcast of ids.
    """
    wanted = hits.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
    wanted = R.small(wanted, rows) if rows is not None else wanted
    found = parent_store(parents.join(wanted, "id", "left_semi")).select(
        F.col("id").alias("_parent"), F.struct(*CHUNK_COLUMNS).alias("_row")
    )
    joined = hits.join(found, F.col("parent_id") == F.col("_parent"), "left")
    own = F.struct(*CHUNK_COLUMNS)
    apart = F.when(F.col("_parent").isNull(), F.col("rank"))
    first = R.W.partitionBy("query_id", "_parent", "_apart").orderBy("rank")
    kept = (
        joined.withColumns({"_row": F.coalesce("_row", own), "_apart": apart})
        .withColumn("_no", F.row_number().over(first))
        .filter(F.col("_no") == 1)
        .select("query_id", "rank", "score", "_row.*")
    )
    return R.rerank_rows(kept, [F.col("rank")])


def parent_expanding_retriever(search: Retriever, parents: DataFrame) -> Retriever:
    def run(queries: DataFrame, k: int = R.TOP_K) -> DataFrame:
        # The hits are used twice; written once, they are searched once, and their
        # counted number lets their parents be selected before any shuffle of text.
        hits = cut_lineage(search(queries, k))
        return expand_to_parents(hits, parents, hits.count())

    return run

"""The retrieval strategies, and all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import chunking as C
from gleaner.operators import dense as D
from gleaner.operators import fusion as FU
from gleaner.operators import ranking as R
from gleaner.operators import rerank as RR
from gleaner.operators.embedding import Embedder, embed_chunks
from gleaner.operators.fusion import Retriever
from gleaner.operators.parents import parent_expanding_retriever
from gleaner.schemas import SECTION_HINT
from gleaner.session import cut_lineage


def strategies(dense: Retriever, sparse: Retriever, rerank: RR.Reranker = RR.lexical_rerank) -> dict[str, Retriever]:
    """Retrievers by strategy name."""
    hybrid = FU.hybrid_retriever(dense, sparse)
    return {"dense": dense, "sparse": sparse, "hybrid": hybrid, "rerank": RR.rerank_retriever(hybrid, rerank)}


def chunker_retrievers(documents: DataFrame, embed: Embedder) -> dict[str, Retriever]:
    """Dense search over one collection per chunker, to compare them. Hits of the
    parent_child collection become their parent sections."""
    searches = {}
    for name, chunker in C.CHUNKERS.items():
        search = D.retriever(cut_lineage(embed_chunks(chunker(documents), embed)), embed)
        if name == "parent_child":
            search = parent_expanding_retriever(search, cut_lineage(C.parent_chunks(documents)))
        searches[name] = search
    return searches


def strategy_hits(
    queries: DataFrame,
    dense: Retriever,
    sparse: Retriever,
    k: int = R.TOP_K,
    rerank: RR.Reranker = RR.lexical_rerank,
    candidates: int = RR.CANDIDATES,
) -> dict[str, DataFrame]:
    """The hits of all four strategies from one dense and one sparse search.

    Both sides are searched once for the largest list any strategy needs; a
    shorter list is a prefix of it. That does not hold with section hints,
    whose over-fetch depends on k.
    """
    if SECTION_HINT in queries.columns:
        raise ValueError("with section hints each strategy must search for itself")
    most = max(k, candidates)
    near, lexical = cut_lineage(dense(queries, most)), cut_lineage(sparse(queries, most))

    def first(hits: DataFrame, n: int) -> DataFrame:
        return hits.filter(F.col("rank") <= n)

    def fused(n: int) -> DataFrame:
        return first(FU.fuse([first(near, n), first(lexical, n)]), n)

    return {
        "dense": first(near, k),
        "sparse": first(lexical, k),
        "hybrid": fused(k),
        "rerank": rerank(fused(candidates), queries, k),
    }

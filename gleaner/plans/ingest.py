"""Posts to indexed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators import chunking as C
from gleaner.operators.embedding import Embedder, embed_chunks
from gleaner.operators.pages import normalize_posts
from gleaner.schemas import CHUNK_KEY, CHUNKERS
from gleaner.sources import collections as K
from gleaner.sources import tables


def ingest(
    posts: DataFrame,
    root: str,
    embed: Embedder,
    dimensions: int,
    chunkers: tuple[str, ...] = CHUNKERS,
    append: bool = False,
) -> dict[str, DataFrame]:
    """Normalize, chunk, embed and upsert; returns a report per chunker.

    Each stage is written before the next one reads it, so a lost executor
    costs one stage's tasks and nothing is computed twice. With ``append`` only
    the collections are updated, which is what increments need.
    """
    spark: SparkSession = posts.sparkSession
    documents = normalize_posts(posts)
    if not append:
        tables.write_documents(documents, f"{root}/documents")
        documents = tables.read_documents(spark, f"{root}/documents").drop("name")
    reports = {}
    for name in chunkers:
        chunks = C.CHUNKERS[name](documents)
        if not append:
            tables.write_chunks(chunks, root, name)
            chunks = tables.read_chunks(spark, root, name)
            if name == "parent_child":
                tables.write_chunks(C.parent_chunks(documents), root, name, parents=True)
        collection = f"{root}/collections/{name}"
        K.ensure_collection(spark, collection, dimensions)
        points = K.as_points(embed_chunks(chunks, embed))
        K.upsert(points, collection, CHUNK_KEY)
        reports[name] = K.index_report(chunks)
    return reports

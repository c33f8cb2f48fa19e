"""Incremental ingest: new posts arrive in a folder and are upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.embedding import Embedder
from gleaner.plans.ingest import ingest
from gleaner.schemas import CHUNKERS, RAW_POST


def stream_posts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RAW_POST).json(folder)


def ingest_stream(
    posts: DataFrame,
    root: str,
    checkpoint: str,
    embed: Embedder,
    dimensions: int,
    chunkers: tuple[str, ...] = CHUNKERS,
) -> StreamingQuery:
    """Upsert every micro-batch. Point ids are deterministic, so a batch that is
    replayed after a failure writes the same points again."""

    def write(batch: DataFrame, _: int) -> None:
        ingest(batch, root, embed, dimensions, chunkers, append=True)

    return (
        posts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

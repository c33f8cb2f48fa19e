"""Embedding text and the embedding seam.

An embedder is a function from a text column to a vector column, so a model is
plugged in as an Arrow-batched pandas UDF. ``hashing_embedder`` is the offline
default: tokens are hashed to buckets inside the JVM and only the bucket
numbers travel to numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gleaner.functions import text as T

# Texts per model call and the default width.
BATCH = 32
DIMENSIONS = 1536

Embedder = Callable[[Column], Column]


def embedding_text(
    title: Column, provider: Column, section: Column, text: Column, always_title: bool = True
) -> Column:
    """Title, provider if any, section, a blank line and the body."""
    title = F.coalesce(title, F.lit("")) if always_title else T.blank_to_null(title)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Provider: "), T.blank_to_null(provider)),
        F.concat(F.lit("Section: "), section),
        F.lit(""),
        F.coalesce(text, F.lit("")),
    )


def chunk_embedding_text() -> Column:
    return embedding_text(*[F.col(c) for c in ("title", "provider", "section", "text")])


def token_buckets(text: Column, dimensions: int) -> Column:
    """Bucket of every lexical token: the first 32 bits of its MD5, modulo the width."""
    return F.transform(
        T.lexical_tokens(text),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimensions).cast("int"),
    )


def hashing_embedder(dimensions: int = 256) -> Embedder:
    def count(buckets: pd.Series) -> pd.Series:
        def one(items) -> np.ndarray:
            counts = np.bincount(np.asarray(items, dtype=np.int64), minlength=dimensions).astype(np.float64)
            length = np.linalg.norm(counts)
            return (counts / length if length else counts).astype(np.float32)

        return buckets.map(one)

    counted = F.pandas_udf(count, ArrayType(FloatType()))
    return lambda text: counted(token_buckets(text, dimensions))


def batched_embedder(call: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> Embedder:
    """Wrap a model call that takes a list of texts; order is kept, empty input never calls it."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            items = texts.tolist()
            vectors: list = []
            for start in range(0, len(items), batch):
                part = items[start : start + batch]
                answer = call(part)
                if len(answer) != len(part):
                    raise ValueError("the embedder must return one vector per text")
                vectors.extend(np.asarray(v, dtype=np.float32) for v in answer)
            yield pd.Series(vectors, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(run, ArrayType(FloatType()))(text)


def embed_chunks(chunks: DataFrame, embed: Embedder, column: str = "embedding") -> DataFrame:
    return chunks.withColumn(column, embed(chunk_embedding_text()))

"""Source records in three shapes and their common form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.schemas import CONTENT_TYPES, RAW_POST
from gleaner.sources.records import read_json

# Fields of the three source shapes.
COMMON = "id string, guid string, slug string, title string, content string, post_date string, post_modified string"
SHAPES = {
    "article": COMMON,
    "review": COMMON + ", review string, provider string",
    "provider": COMMON + ", name string",
}
# Providers that article titles are searched for, in order.
KNOWN_PROVIDERS = ("Nextiva", "RingCentral")


def read_records(spark: SparkSession, path: str, content_type: str, lines: bool = False) -> DataFrame:
    """A JSON array of records per file, or with ``lines`` one record per line. A
    file that is not there or does not hold records fails."""
    if content_type not in SHAPES:
        raise ValueError(f"unknown content type: {content_type}")
    return read_json(spark, path, SHAPES[content_type], lines)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _first_written(*columns: str) -> Column:
    return F.coalesce(*[T.blank_to_null(F.col(c)) for c in columns], F.lit(""))


def infer_provider(*parts: Column, names: tuple[str, ...] = KNOWN_PROVIDERS) -> Column:
    """The first known name that occurs, ignoring case, in the joined parts."""
    blob = F.lower(F.concat_ws(" ", *[T.blank_to_null(p) for p in parts]))
    none = F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.contains(blob, F.lit(n.lower())), F.lit(n)) for n in names], none)


def clean_url(url: Column) -> Column:
    return T.unescape_html(T.blank_to_null(url))


def as_posts(records: DataFrame, content_type: str, names: tuple[str, ...] = KNOWN_PROVIDERS) -> DataFrame:
    """Records of one shape as raw posts (``schemas.RAW_POST``)."""
    html, title = _text("content"), _text("title")
    if content_type == "article":
        provider = infer_provider(F.col("title"), F.col("slug"), names=names)
    elif content_type == "review":
        html, provider = _first_written("review", "content"), F.col("provider")
    elif content_type == "provider":
        title = _first_written("name", "title")
        provider = T.blank_to_null(title)
    else:
        raise ValueError(f"unknown content type: {content_type}")
    return records.select(
        F.col("id").cast("string").alias("id"),
        title.alias("title"),
        _text("slug").alias("slug"),
        html.alias("html"),
        F.lit(content_type).alias("content_type"),
        provider.alias("provider"),
        clean_url(F.col("guid")).alias("url"),
        F.col("post_date").alias("published_at"),
        F.col("post_modified").alias("updated_at"),
    )


def union_posts(records: dict[str, DataFrame], content_type: str | None = None) -> DataFrame:
    """All shapes, or the one asked for."""
    wanted = [t for t in CONTENT_TYPES if t in records and content_type in (None, t)]
    if not wanted:
        raise ValueError("no records of that type")
    return reduce(DataFrame.unionByName, [as_posts(records[t], t) for t in wanted])


def read_posts(
    spark: SparkSession, paths: dict[str, str], content_type: str | None = None, lines: bool = False
) -> DataFrame:
    wanted = {t: p for t, p in paths.items() if content_type in (None, t)}
    return union_posts({t: read_records(spark, p, t, lines) for t, p in wanted.items()}, content_type)


def get_post(posts: DataFrame, post_id: str | int, content_type: str | None = None) -> DataFrame:
    """The first post with that id, articles before reviews before providers;
    fails if there is none."""
    found = posts.filter(F.col("id") == str(post_id))
    if content_type is not None:
        found = found.filter(F.col("content_type") == content_type)
    if found.isEmpty():
        raise KeyError(f"no post with id {post_id!r} ({content_type or 'any type'})")
    priority = F.array_position(F.array(*[F.lit(t) for t in CONTENT_TYPES]), F.col("content_type"))
    return found.orderBy(priority, "title", "html").limit(1)


__all__ = ["RAW_POST", "as_posts", "clean_url", "get_post", "infer_provider", "read_posts", "read_records", "union_posts"]

"""Export of published posts from relational ``posts`` and ``postmeta`` tables.

The tables come from any Spark source, e.g. ``spark.read.jdbc`` with a
partition column. Everything published is exported unless the caller asks for
the newest N, which is ``TakeOrderedAndProject``; attributes are joined only
onto the rows that were kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Post types and review attributes.
ARTICLE_TYPES = ("blog_post", "news_post", "library_post")
REVIEW_META = (
    "cons",
    "pros",
    "provider",
    "review",
    "rating_price",
    "rating_total",
    "rating_quality",
    "rating_support",
    "rating_features",
    "rating_reliability",
    "rating_installation",
    "verified_review",
    "would_recommend",
)


def eav_pivot(meta: DataFrame, keys: tuple[str, ...], entity: str = "post_id", key: str = "meta_key",
              value: str = "meta_value", order: str = "meta_id") -> DataFrame:
    """(entity, key, value) rows to one row per entity; the last value of a key wins.

    Partial aggregation runs before the shuffle, so an entity with very many
    rows stays small."""
    last = [F.max_by(F.when(F.col(key) == k, F.col(value)), F.when(F.col(key) == k, F.col(order))).alias(k) for k in keys]
    return meta.filter(F.col(key).isin(*keys)).groupBy(entity).agg(*last)


# Ids of at most so many rows are broadcast.
BROADCAST_IDS = 100_000


def newest(posts: DataFrame, types: tuple[str, ...], limit: int | None, *order: str) -> DataFrame:
    """Published posts, or the newest ``limit`` of them."""
    published = posts.filter(F.col("post_type").isin(*types) & (F.col("post_status") == "publish"))
    if limit is None:
        return published
    return published.orderBy(*[F.col(c).desc() for c in (*order, "ID")]).limit(limit)


def _ids(rows: DataFrame, limit: int | None) -> DataFrame:
    """A side whose size is bounded by the limit may be broadcast."""
    return F.broadcast(rows) if limit is not None and limit <= BROADCAST_IDS else rows


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _common(name: str) -> dict[str, Column]:
    return {
        "id": F.col("ID"),
        "guid": _text("guid"),
        "slug": _text("post_name"),
        name: _text("post_title"),
        "content": _text("post_content"),
        "post_date": _text("post_date"),
        "post_type": F.col("post_type"),
        "post_status": F.col("post_status"),
        "post_modified": _text("post_modified"),
    }


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def export_articles(posts: DataFrame, limit: int | None = None) -> DataFrame:
    rows = newest(posts, ARTICLE_TYPES, limit, "post_date")
    return _select(rows, _common("title") | {"excerpt": _text("post_excerpt")})


def _with_meta(rows: DataFrame, meta: DataFrame, keys: tuple[str, ...], limit: int | None) -> DataFrame:
    wanted = meta.join(_ids(rows.select(F.col("ID").alias("post_id")), limit), "post_id", "left_semi")
    pivoted = eav_pivot(wanted, keys).withColumnRenamed("post_id", "ID")
    renamed = pivoted.select("ID", *[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(renamed, "ID", "left")


def export_providers(posts: DataFrame, meta: DataFrame, limit: int | None = None) -> DataFrame:
    rows = newest(posts, ("provider",), limit, "post_modified", "post_date")
    joined = _with_meta(rows, meta, ("meta_description",), limit)
    return _select(joined, _common("name") | {"meta_description": _text("_meta_description")})


def export_reviews(posts: DataFrame, meta: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews with their attributes and the title of the provider they point to."""
    rows = newest(posts, ("user-reviews",), limit, "post_date")
    joined = _with_meta(rows, meta, REVIEW_META, limit)
    digits = F.when(F.col("_provider").rlike("^[0-9]+$"), F.col("_provider").try_cast("bigint"))
    numbered = joined.withColumn("provider_id", digits)
    names = posts.select(F.col("ID").alias("provider_id"), F.col("post_title").alias("_name"))
    wanted = names.join(_ids(numbered.select("provider_id").distinct(), limit), "provider_id", "left_semi")
    named = numbered.join(wanted, "provider_id", "left")
    attributes = {k: _text(f"_{k}") for k in REVIEW_META if k != "provider"}
    return _select(
        named, _common("title") | attributes | {"provider": _text("_name"), "provider_id": F.col("provider_id")}
    )

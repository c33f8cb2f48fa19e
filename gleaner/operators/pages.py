"""Pages to sections. Every step works within one page, so nothing is shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from gleaner.functions import markup
from gleaner.schemas import SECTION

BLOCK = StructType().add("kind", StringType()).add("level", IntegerType()).add("text", StringType())


@F.pandas_udf(StringType())
def clean_html(html: pd.Series) -> pd.Series:
    return html.map(markup.clean_page)


@F.pandas_udf(ArrayType(BLOCK))
def parse_blocks(html: pd.Series) -> pd.Series:
    return html.map(
        lambda h: [{"kind": k, "level": level, "text": t} for k, level, t in markup.page_blocks(h)]
    )


def block_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per block: ``pos, kind, level, text`` with the other page columns."""
    blocks = pages.withColumn("_blocks", parse_blocks(F.col(html))).drop(html)
    return blocks.select(
        *[c for c in blocks.columns if c != "_blocks"], F.posexplode("_blocks").alias("pos", "_b")
    ).select("*", "_b.kind", "_b.level", "_b.text").drop("_b")


def sections_of(title: Column, blocks: Column) -> Column:
    """Fold blocks into sections.

    A heading closes the open section, replaces the headings of its level and
    below, and opens the next one. The path starts with the title and leaves
    out headings equal to it. Sections without text vanish, their headings
    stay in the paths below them.
    """
    heading_type = "array<struct<level:int,text:string>>"

    def state(done: Column, above: Column, heading: Column, parts: Column) -> Column:
        return F.struct(
            done.alias("done"), above.alias("above"), heading.alias("heading"), parts.alias("parts")
        )

    def closed(s: Column) -> Column:
        path = F.concat(
            F.array(title),
            F.transform(F.filter(s["above"], lambda x: x["text"] != title), lambda x: x["text"]),
        )
        section = F.struct(
            s["heading"].alias("heading"),
            path.alias("heading_path"),
            F.array_join(s["parts"], "\n\n").alias("text"),
        )
        return F.when(F.size(s["parts"]) > 0, F.concat(s["done"], F.array(section))).otherwise(s["done"])

    def step(s: Column, b: Column) -> Column:
        kept = F.filter(s["above"], lambda x: x["level"] < b["level"])
        above = F.concat(kept, F.array(F.struct(b["level"].alias("level"), b["text"].alias("text"))))
        return F.when(
            b["kind"] == "heading", state(closed(s), above, b["text"], F.array().cast("array<string>"))
        ).otherwise(
            state(s["done"], s["above"], s["heading"], F.concat(s["parts"], F.array(b["text"])))
        )

    start = state(
        F.array().cast(f"array<{SECTION}>"),
        F.array().cast(heading_type),
        title,
        F.array().cast("array<string>"),
    )
    return F.aggregate(blocks, start, step, closed)


def normalize_posts(posts: DataFrame) -> DataFrame:
    """Raw posts (``schemas.RAW_POST``) to documents (``schemas.DOCUMENT``)."""
    blocks = posts.withColumn("_blocks", parse_blocks(F.col("html")))
    return blocks.select(
        "id", "title", "content_type", "provider", "url", "published_at", "updated_at",
        sections_of(F.col("title"), F.col("_blocks")).alias("sections"),
    )

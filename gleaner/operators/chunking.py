"""Three ways to cut documents into chunks.

Input is one row per document with its sections nested (``schemas.DOCUMENT``).
Every chunker is a map over documents: no shuffle, and a document never meets
another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.schemas import CHUNK_COLUMNS

# Default sizes in whitespace tokens.
TARGET_MIN = 300
TARGET_MAX = 700
HARD_MAX = 1000
OVERLAP = 80
CHILD_SIZE = 150
CHILD_OVERLAP = 40

PARAGRAPH_BREAK = rf"(?U)\n{T.SPACE_CLASS}*\n"
SENTENCE_BREAK = rf"(?U)(?<=[.!?]){T.SPACE_CLASS}+"
UNIT = "struct<u:string,n:int>"


def word_windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``words``; the last one is the first to reach the end."""
    size = max(size, 1)
    step = max(size - overlap, 1)
    extra = F.ceil(F.greatest(F.size(words) - size, F.lit(0)) / F.lit(step)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), extra),
        lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "),
    )
    return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), T.strip), lambda x: x != "")


def split_units(text: Column, target_max: int = TARGET_MAX) -> Column:
    """Paragraphs; those above ``target_max`` tokens as sentences."""
    return F.flatten(
        F.transform(
            _pieces(text, PARAGRAPH_BREAK),
            lambda p: F.when(T.count_tokens(p) <= target_max, F.array(p)).otherwise(
                _pieces(p, SENTENCE_BREAK)
            ),
        )
    )


def _joined(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda x: x["u"]), "\n\n")


def _overlap_tail(units: Column, overlap: int) -> Column:
    """Trailing units of at most ``overlap`` tokens, but never fewer than one."""
    start = F.struct(
        F.array().cast(f"array<{UNIT}>").alias("kept"),
        F.lit(0).alias("n"),
        F.lit(False).alias("full"),
    )

    def take(state: Column, unit: Column) -> Column:
        full = state["full"] | ((F.size(state["kept"]) > 0) & (state["n"] + unit["n"] > overlap))
        return F.when(
            full, F.struct(state["kept"].alias("kept"), state["n"].alias("n"), F.lit(True).alias("full"))
        ).otherwise(
            F.struct(
                F.concat(F.array(unit), state["kept"]).alias("kept"),
                (state["n"] + unit["n"]).alias("n"),
                F.lit(False).alias("full"),
            )
        )

    return F.aggregate(F.reverse(units), start, take, lambda s: s["kept"])


def _tokens_of(units: Column) -> Column:
    return F.aggregate(units, F.lit(0), lambda acc, x: acc + x["n"])


def pack_units(
    units: Column,
    target_min: int = TARGET_MIN,
    target_max: int = TARGET_MAX,
    hard_max: int = HARD_MAX,
    overlap: int = OVERLAP,
) -> Column:
    """Greedy windows over ``array<struct<u,n>>``, each seeded with the tail of the one before.

    A window closes when the next unit would exceed ``target_max``. A unit above
    ``hard_max`` closes the open window and is cut into word windows by itself.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast(f"array<{UNIT}>").alias("open"),
        F.lit(0).alias("n"),
    )

    def state(done: Column, opened: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), n.cast("int").alias("n"))

    def close_if_full(s: Column, unit: Column) -> Column:
        full = (F.size(s["open"]) > 0) & (s["n"] + unit["n"] > target_max)
        return F.when(
            full,
            T.let(
                _overlap_tail(s["open"], overlap),
                lambda seed: state(
                    F.concat(s["done"], F.array(_joined(s["open"]))), seed, _tokens_of(seed)
                ),
            ),
        ).otherwise(s)

    def append(s: Column, unit: Column) -> Column:
        still_open = F.when(F.size(s["open"]) > 0, F.array(_joined(s["open"]))).otherwise(
            F.array().cast("array<string>")
        )
        forced = T.let(T.words(unit["u"]), lambda w: word_windows(w, target_min, overlap))
        return F.when(
            unit["n"] > hard_max,
            state(
                F.concat(s["done"], still_open, forced),
                F.array().cast(f"array<{UNIT}>"),
                F.lit(0),
            ),
        ).otherwise(
            state(s["done"], F.concat(s["open"], F.array(unit)), s["n"] + unit["n"])
        )

    def finish(s: Column) -> Column:
        last = F.when(F.size(s["open"]) > 0, F.array(_joined(s["open"])))
        return F.coalesce(F.concat(s["done"], last), s["done"])

    return F.aggregate(
        units, start, lambda s, u: T.let(close_if_full(s, u), lambda c: append(c, u)), finish
    )


def _section_parts(text: Column, target_min, target_max, hard_max, overlap) -> Column:
    def packed(t: Column) -> Column:
        sized = F.transform(
            split_units(t, target_max),
            lambda u: F.struct(u.alias("u"), T.count_tokens(u).alias("n")),
        )
        return pack_units(sized, target_min, target_max, hard_max, overlap)

    return F.when(T.count_tokens(text) <= target_max, F.array(T.strip(text))).otherwise(packed(text))


def _written_sections(sections: Column) -> Column:
    return F.filter(sections, lambda s: ~T.is_blank(s["text"]))


def _one_row_per_part(documents: DataFrame, parts: Column) -> DataFrame:
    """Explode ``array<array<struct<heading,heading_path,text,no>>>`` in reading order.

    The array is built inside the generator: as a column of its own it would
    be computed again for the filters that Spark infers from an explode."""
    return documents.select(
        "*", F.posexplode(F.flatten(parts)).alias("chunk_no", "_part")
    ).drop("sections")


def _per_section(documents: DataFrame, split) -> DataFrame:
    parts = F.transform(
        _written_sections(F.col("sections")),
        lambda s: F.transform(
            split(s["text"]),
            lambda t, i: F.struct(
                s["heading"].alias("heading"),
                s["heading_path"].alias("heading_path"),
                t.alias("text"),
                (i + 1).cast("int").alias("no"),
            ),
        ),
    )
    return _one_row_per_part(documents, parts)


def _as_chunks(rows: DataFrame, chunk_id: Column, heading: Column, path: Column, text: Column,
               parent_id: Column | None = None) -> DataFrame:
    return rows.select(
        "content_type",
        F.col("id").alias("document_id"),
        "chunk_no",
        chunk_id.alias("id"),
        "provider",
        "title",
        heading.alias("section"),
        path.alias("heading_path"),
        text.alias("text"),
        F.col("url").alias("source_url"),
        "updated_at",
        (F.lit(None).cast("string") if parent_id is None else parent_id).alias("parent_id"),
    ).select(*CHUNK_COLUMNS)


def _id(*parts: Column | str) -> Column:
    return F.concat_ws("_", F.col("content_type"), F.col("id"), *parts)


def structure_aware_chunks(
    documents: DataFrame,
    target_min: int = TARGET_MIN,
    target_max: int = TARGET_MAX,
    hard_max: int = HARD_MAX,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One chunk per section; sections above ``target_max`` tokens as packed windows."""
    rows = _per_section(
        documents, lambda t: _section_parts(t, target_min, target_max, hard_max, overlap)
    )
    part = F.col("_part")
    return _as_chunks(
        rows,
        _id(T.slug(part["heading"]), T.padded(part["no"])),
        part["heading"],
        part["heading_path"],
        part["text"],
    )


def fixed_size_chunks(documents: DataFrame, size: int = TARGET_MAX, overlap: int = OVERLAP) -> DataFrame:
    """Word windows over the whole body, headings ignored."""
    body = F.array_join(
        F.transform(_written_sections(F.col("sections")), lambda s: T.strip(s["text"])), "\n\n"
    )
    heading = F.coalesce(T.blank_to_null(F.col("title")), F.lit("Document"))
    windows = T.let(T.words(body), lambda w: word_windows(w, size, max(overlap, 0)))
    rows = documents.select("*", F.posexplode(windows).alias("chunk_no", "_text"))
    return _as_chunks(
        rows,
        _id(F.lit("fixed"), T.padded(F.col("chunk_no") + 1)),
        heading,
        F.array(heading),
        F.col("_text"),
    )


def _parent_id(heading: Column) -> Column:
    return _id(T.slug(heading), F.lit("parent"))


def child_chunks(
    documents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP
) -> DataFrame:
    """Small windows per section, each pointing at its parent section."""
    size, overlap = max(size, 1), max(overlap, 0)

    def split(text: Column) -> Column:
        return T.let(
            T.words(text),
            lambda w: F.when(F.size(w) <= size, F.array(T.strip(text))).otherwise(
                word_windows(w, size, overlap)
            ),
        )

    rows = _per_section(documents, split)
    part = F.col("_part")
    return _as_chunks(
        rows,
        _id(T.slug(part["heading"]), F.lit("child"), T.padded(part["no"])),
        part["heading"],
        part["heading_path"],
        part["text"],
        _parent_id(part["heading"]),
    )


def parent_chunks(documents: DataFrame) -> DataFrame:
    """One row per written section with its full text."""
    rows = _per_section(documents, lambda t: F.array(T.strip(t)))
    part = F.col("_part")
    return _as_chunks(
        rows, _parent_id(part["heading"]), part["heading"], part["heading_path"], part["text"]
    )


CHUNKERS = {
    "structure_aware": structure_aware_chunks,
    "fixed_size": fixed_size_chunks,
    "parent_child": child_chunks,
}

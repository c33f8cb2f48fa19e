"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.session import ensure_checkpoint_dir

# Characters that separate words, after A-Z became a-z: everything below 0x80
# but digits and lower-case letters.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SCAN_BLOCK = 256

# The same for UTF-8 bytes: separators become blanks, so that bytes.split()
# yields the words.
_word = set(range(0x80, 0x100)) | set(range(0x30, 0x3A)) | set(range(0x61, 0x7B))
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _word else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character kept."""
    return F.translate(text, UPPER, LOWER)


def word_text(text: Column) -> Column:
    """The words of a text between single blanks, with one blank at either end."""
    blanks = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), f"[{SEPARATORS}]+", " ")
    return F.concat(F.lit(" "), F.btrim(blanks, F.lit(" ")), F.lit(" "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def in_blocks(rows: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``rows`` cut into arrays of at most ``SCAN_BLOCK``. A fold copies what it has
    gathered at every step, so folds over blocks stay linear where one over all rows doesn't."""

    def cut(all_rows: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_rows), F.lit(1)) - 1) / SCAN_BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_rows, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))

    return let(rows, lambda all_rows: let(cut(all_rows), use))


def before_blocks(blocks: Column, first: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The state that ``fold`` reaches before each block, and after the last one."""

    def step(states: Column, block: Column) -> Column:
        return F.concat(states, F.array(F.aggregate(block, F.element_at(states, -1), fold)))

    return F.aggregate(blocks, F.array(first), step)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps neither
    recompute it nor depend on an executor staying alive."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def own_column(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def prefixed(df: DataFrame) -> DataFrame:
    """All columns as ``d_...``, so that an operator's own names are free."""
    return df.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in df.columns])


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`d_{c}`").alias(c) for c in columns])


def worker_cache(key: str) -> dict:
    """A dictionary that lives as long as the Python worker."""
    module = sys.modules.setdefault("gleaner_worker_cache", types.ModuleType("gleaner_worker_cache"))
    return module.__dict__.setdefault(key, {})

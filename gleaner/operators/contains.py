"""Which of many needles occur in which texts, in one scan of the texts.

The needles form one multi-pattern automaton per task, so the work grows with
the texts and the matches, not with texts times needles. Only as many needles
as fit a bounded broadcast are searched per scan. Where only their presence counts, the
scans of most needles are over distinct words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.session import written

try:
    import ahocorasick
except ImportError:  # plain substring tests give the same result, at the cost of every needle
    ahocorasick = None

# What a text's words are made of, and needles that can only lie within one word.
WORD, WORD_NEEDLE = "[a-z0-9]+", "^[a-z0-9]+\\z"
NEEDLES_PER_SCAN = 50_000
BYTES_PER_SCAN = 16 << 20


def _finder(needles: list[str]) -> Callable[[str], set[str]]:
    if ahocorasick is None or not needles:
        return lambda text: {n for n in needles if n in text}
    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    return lambda text: {needle for _, needle in automaton.iter(text)}


def _blocks(needles: DataFrame, column: str) -> Iterator[list[str]]:
    wanted = needles.select(F.col(column).alias("needle")).filter("needle <> ''").distinct()
    rows, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle").cast("long")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / NEEDLES_PER_SCAN), math.ceil(size / BYTES_PER_SCAN))
    for block in range(blocks):
        own = F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block
        yield [row.needle for row in wanted.filter(own).toLocalIterator()]


def occurrences(texts: DataFrame, needles: DataFrame, key: list[str], text: str = "text",
                needle: str = "needle") -> DataFrame:
    """``(*key, needle)`` for every needle that is a substring of a text."""
    narrow = texts.select(*key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    schema = StructType([narrow.schema[c] for c in key]).add(needle, "string")
    context = texts.sparkSession.sparkContext

    def scan_for(block: list[str]) -> DataFrame:
        shared = context.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _finder(shared.value)
            for batch in batches:
                found = batch["_text"].map(lambda t: sorted(find(t)))
                yield batch[key].assign(**{needle: found}).explode(needle).dropna(subset=[needle])

        return narrow.mapInPandas(scan, schema)

    return reduce(DataFrame.unionByName, [scan_for(b) for b in _blocks(needles, needle)])


def present(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """The needles that occur in any text.

    One of letters and digits only lies within a word of a text. So these are looked for in the
    distinct words, which one pass gathers: those that are words by a join, the others by scans. Only the rest needs the texts."""
    wanted = needles.select(F.col(needle).alias(needle)).filter(F.col(needle) != "").distinct()
    plain = F.col(needle).rlike(WORD_NEEDLE)
    parts = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    words = written(texts.select(F.explode(parts).alias(text)).distinct(), "words")
    as_word = words.select(F.col(text).alias(needle))
    inner = written(wanted.filter(plain).join(as_word, needle, "left_anti"), "needles")
    found = wanted.filter(plain).join(as_word, needle, "left_semi")
    return found.unionByName(scanned(words, inner, text, needle)).unionByName(scanned(texts, wanted.filter(~plain), text, needle))


def scanned(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """The needles that occur in any text, by scans of all texts. Every task reports a needle once."""
    narrow = texts.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    context = texts.sparkSession.sparkContext

    def scan_for(block: list[str]) -> DataFrame:
        shared = context.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _finder(shared.value)
            seen: set[str] = set()
            for batch in batches:
                for value in batch["_text"]:
                    seen |= find(value)
            yield pd.DataFrame({needle: sorted(seen)}, dtype=object)

        return narrow.mapInPandas(scan, f"`{needle}` string")

    return reduce(DataFrame.unionByName, [scan_for(b) for b in _blocks(needles, needle)]).distinct()

"""What the corpus knows: providers, their aliases, headings, and what occurs in its text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import contains
from gleaner.schemas import CHUNK_KEY
from gleaner.session import written


class Catalog(NamedTuple):
    providers: DataFrame  # name
    aliases: DataFrame  # needle, name
    headings: DataFrame  # heading, first: order of first appearance
    corpus: DataFrame  # text, lower-cased


def aliases_for(providers: DataFrame) -> DataFrame:
    """Lower case, lower case without spaces, camel case split and lowered."""
    name = F.col("name")
    spellings = F.array(
        F.lower(name),
        F.replace(F.lower(name), F.lit(" "), F.lit("")),
        F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")),
    )
    return providers.select(F.explode(F.array_distinct(spellings)).alias("needle"), "name")


def _catalog(providers: DataFrame, headings: DataFrame, corpus: DataFrame) -> Catalog:
    names = providers.filter(F.coalesce("name", F.lit("")) != "").distinct()
    first = headings.filter(F.coalesce("heading", F.lit("")) != "").groupBy("heading").agg(F.min("at").alias("first"))
    return Catalog(names, aliases_for(names), first, corpus)


def catalog_from_chunks(chunks: DataFrame) -> Catalog:
    return _catalog(
        chunks.select(F.col("provider").alias("name")),
        chunks.select(F.col("section").alias("heading"), F.struct(*CHUNK_KEY).alias("at")),
        chunks.select(F.lower(F.concat_ws("\n", "title", "section", "text")).alias("text")),
    )


def catalog_from_documents(documents: DataFrame) -> Catalog:
    sections = documents.select("content_type", "id", "title", F.posexplode("sections").alias("pos", "s"))
    headings = sections.select(
        F.col("s.heading").alias("heading"), F.struct("content_type", "id", "pos").alias("at")
    )
    titles = documents.select(F.lower("title").alias("text"))
    texts = sections.select(F.lower(F.concat_ws("\n", "s.heading", "s.text")).alias("text"))
    return _catalog(documents.select(F.col("provider").alias("name")), headings, titles.unionByName(texts))


def load_catalog(chunks: DataFrame | None, documents: DataFrame | None = None) -> Catalog:
    """From the collection; from the documents when it has no providers and no headings."""
    if chunks is not None:
        known = chunks.filter("provider <> '' OR section <> ''")
        if documents is None or not known.isEmpty():
            return catalog_from_chunks(chunks)
    if documents is None:
        raise ValueError("a catalog needs chunks or documents")
    return catalog_from_documents(documents)


def alias_order() -> Column:
    """Longer aliases first, then by name."""
    return F.struct((-F.length("needle")).alias("shorter"), F.col("name"), F.col("needle"))


def _runs(text: Column) -> Column:
    """Alternating runs of word and other characters; word boundaries lie between them."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|\W+)"), F.lit(0))


def _bounded_spans(text: Column, longest: Column) -> Column:
    """All substrings of up to ``longest`` runs that start and end at a word boundary."""

    def spans(runs: Column) -> Column:
        n = F.size(runs)
        word = F.transform(runs, lambda r: r.rlike(r"(?U)^\w"))

        def from_run(i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(longest, n - i + 1))
            ends = F.filter(lengths, lambda m: (i + m - 1 < n) | F.get(word, n - 1))
            return F.transform(ends, lambda m: F.array_join(F.slice(runs, i, m), ""))

        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i > 1) | F.get(word, F.lit(0)))
        return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, from_run))))

    return T.let(_runs(F.lower(text)), spans)


def match_providers(texts: DataFrame, aliases: DataFrame, text: str = "query", to: str = "providers") -> DataFrame:
    """Add the names whose aliases occur as whole words, in alias order.

    A whole-word occurrence is a substring between two word boundaries, so the
    match is an equi-join of such substrings with the aliases, not a regular
    expression per pair.
    """
    longest = aliases.agg(F.max(F.size(_runs(F.col("needle"))))).scalar()
    spans = texts.withColumn("_longest", F.coalesce(longest, F.lit(1))).select(
        "query_id", F.explode(_bounded_spans(F.col(text), F.col("_longest"))).alias("needle")
    )
    names = (
        spans.join(aliases, "needle")
        .groupBy("query_id", "name")
        .agg(F.min(alias_order()).alias("at"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_found"))
    )
    found = names.select("query_id", F.transform("_found", lambda x: x["name"]).alias(to))
    none = F.array().cast("array<string>")
    return texts.join(found, "query_id", "left").withColumn(to, F.coalesce(to, none))


def canonicalize(texts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Replace every alias, longest first, by its canonical name, ignoring case.

    Replacing an alias never changes the text without spaces and case, so only
    aliases that occur in that form can ever apply. They are found by an
    equi-join and folded over the text in alias order.
    """

    def bare(value: Column) -> Column:
        return F.replace(F.lower(value), F.lit(" "), F.lit(""))

    keyed = aliases.withColumn("bare", bare(F.col("needle")))
    lengths = keyed.agg(F.collect_set(F.length("bare"))).scalar()

    def parts(value: Column) -> Column:
        def of_length(m: Column) -> Column:
            starts = F.when(F.length(value) >= m, F.sequence(F.lit(1), F.length(value) - m + 1))
            return F.coalesce(
                F.transform(starts, lambda i: F.substring(value, i, m)), F.array().cast("array<string>")
            )

        return F.array_distinct(F.flatten(F.transform("_lengths", of_length)))

    applicable = (
        texts.withColumn("_lengths", lengths)
        .select("query_id", F.explode(T.let(bare(F.col(text)), parts)).alias("bare"))
        .join(keyed, "bare")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set(alias_order())).alias("_aliases"))
    )

    def replaced(value: Column, alias: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)\b\Q"), alias["needle"], F.lit(r"\E\b"))
        quoted = F.regexp_replace(alias["name"], r"([\\$])", r"\\$1")
        return F.regexp_replace(value, pattern, quoted)

    joined = texts.join(applicable, "query_id", "left")
    folded = F.aggregate("_aliases", F.col(text), replaced)
    return joined.withColumn(text, F.coalesce(folded, F.col(text))).drop("_aliases")


def grounded_topics(topics: DataFrame, catalog: Catalog) -> DataFrame:
    """``(topic, allowed)``: the topic occurs in the corpus, or it has words of more
    than three characters and all of those do. Without a corpus all is allowed."""
    wanted = topics.select("topic").distinct()
    if catalog.corpus.filter("text <> ''").isEmpty():
        return wanted.withColumn("allowed", F.lit(True))
    # A number stands for the topic where its words meet the corpus: one text would move with each of them.
    numbered = written(wanted.withColumn("_topic", F.monotonically_increasing_id()), "topics")
    needle = T.strip(F.lower(F.col("topic")))
    long_words = F.filter(
        F.regexp_extract_all(needle, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 3
    )
    # A topic that occurs brings its words along, so only one without long words is
    # looked for as a whole: the needles are a vocabulary, not all the topics' text.
    words = F.transform(
        F.array_distinct(long_words), lambda w: F.struct(w.alias("needle"), F.lit(False).alias("whole"))
    )
    whole = F.array(F.struct(needle.alias("needle"), F.lit(True).alias("whole")))
    parts = numbered.select("_topic", F.explode(F.when(F.size(words) == 0, whole).otherwise(words)).alias("part")).select(
        "_topic", "part.*"
    )
    found = contains.present(catalog.corpus, parts).withColumn("found", F.lit(True))
    hit = F.coalesce("found", F.lit(False))
    allowed = (
        parts.join(found, "needle", "left")
        .groupBy("_topic")
        .agg(
            F.bool_or(hit & F.col("whole")).alias("whole"),
            F.bool_and(F.when(~F.col("whole"), hit)).alias("words"),
        )
        .select("_topic", (F.col("whole") | F.coalesce("words", F.lit(False))).alias("allowed"))
    )
    return numbered.join(allowed, "_topic").select("topic", "allowed")

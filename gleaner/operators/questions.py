"""Understanding and rewriting questions, a table of them at a time.

Model answers enter as a column of JSON text next to the question; whatever
cannot be used falls back to the offline rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.catalog import Catalog, canonicalize, grounded_topics, match_providers
from gleaner.schemas import QUERY_KINDS, SECTION_HINT

# Opening phrases that carry no content, the terms a kind of
# question must contain, and the alternate wording it is searched with.
FILLER = (
    r"(?iU)^(please\s+)?(can you|could you|would you)?\s*"
    r"(tell me|explain|i (want|need|would like) to know)\s+"
)
KIND_TERMS = {"pricing": ["pricing", "cost"], "review": ["reviews"], "comparison": ["compare"]}
ALTERNATES = {"pricing": "plans per user", "review": "customer support"}
DEFAULT_KIND = "factual"


def _none() -> Column:
    return F.array().cast("array<string>")


def heuristic_extraction(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Add kind, providers, topics and source by the offline rules."""
    return match_providers(queries, catalog.aliases).withColumns(
        {"kind": F.lit(DEFAULT_KIND), "topics": _none(), "source": F.lit("heuristic")}
    )


def _strings(payload: Column, path: str) -> Column:
    """A list of strings; empty when the field is absent, NULL when it is anything else."""
    field = F.try_variant_get(payload, path, "variant")
    items = F.try_variant_get(payload, path, "array<variant>")
    texts = F.transform(
        items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    )
    return F.when(field.isNull(), _none()).when(~F.exists(texts, lambda t: t.isNull()), texts)


def _object(answer: Column) -> Column:
    payload = F.try_parse_json(answer)
    return F.when(F.schema_of_variant(payload).startswith("OBJECT"), payload)


def model_extraction(queries: DataFrame, catalog: Catalog, source: str = "openai") -> DataFrame:
    """Read ``answer`` (JSON text) into kind, providers, topics and source.

    The answer must be an object with a known kind and lists of strings.
    Providers are kept if the question names them, in the catalog's spelling;
    topics if the corpus knows them.
    """
    payload = F.try_parse_json("answer")
    kind = F.try_variant_get(payload, "$.kind", "variant")
    named = F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get(payload, "$.kind", "string"))
    read = match_providers(queries, catalog.aliases, to="_mentioned").withColumns(
        {
            "_kind": F.when(named.isin(*QUERY_KINDS), named),
            "_providers": _strings(payload, "$.providers"),
            "_topics": _strings(payload, "$.topics"),
        }
    )
    usable = F.col("_kind").isNotNull() & F.col("_providers").isNotNull() & F.col("_topics").isNotNull()
    topics = read.filter(usable).select(F.explode("_topics").alias("topic"))
    allowed = grounded_topics(topics, catalog).filter("allowed")
    kept_topics = (
        read.filter(usable)
        .select("query_id", F.posexplode("_topics").alias("pos", "topic"))
        .join(allowed, "topic")
        .groupBy("query_id", "topic")
        .agg(F.min("pos").alias("pos"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "topic"))).alias("_kept"))
        .select("query_id", F.transform("_kept", lambda x: x["topic"]).alias("_kept"))
    )

    def canonical(name: Column) -> Column:
        same = F.filter(F.array_sort("_mentioned"), lambda m: F.lower(m) == F.lower(name))
        return F.get(F.reverse(same), F.lit(0))

    providers = F.array_distinct(
        F.filter(F.transform("_providers", canonical), lambda p: p.isNotNull())
    )
    return (
        read.join(kept_topics, "query_id", "left")
        .withColumns(
            {
                "kind": F.coalesce(F.when(usable, F.col("_kind")), F.lit(DEFAULT_KIND)),
                "providers": F.when(usable & (F.size(providers) > 0), providers).otherwise(F.col("_mentioned")),
                "topics": F.coalesce(F.when(usable, F.col("_kept")), _none()),
                "source": F.when(usable, F.lit(source)).otherwise(F.lit("heuristic")),
            }
        )
        .drop("_mentioned", "_kind", "_providers", "_topics", "_kept")
    )


def ensure_terms(text: Column, terms: list[str]) -> Column:
    """Append the terms that are not already a substring, ignoring case."""
    lowered = F.lower(text)
    return T.strip(
        F.concat_ws(" ", text, *[F.when(~F.contains(lowered, F.lit(t)), F.lit(t)) for t in terms])
    )


def _tidy(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, T.SPACES, " "), F.lit(" ?"))


def rewrite(queries: DataFrame, catalog: Catalog, use_kind: bool = True, to: str = "rewritten") -> DataFrame:
    """Offline rewrite: filler off, canonical names, terms of the kind added."""
    stripped = T.strip(F.col("query"))
    started = queries.withColumn("_text", _tidy(F.regexp_replace(stripped, FILLER, "")))
    named = canonicalize(started, catalog.aliases, "_text")
    text = F.col("_text")
    if use_kind:
        worded = reduce(
            lambda acc, kind: acc.when(F.col("kind") == kind, ensure_terms(text, KIND_TERMS[kind])),
            KIND_TERMS,
            F.when(F.lit(False), text),
        ).otherwise(text)
    else:
        worded = text
    return named.withColumn(to, F.when(text == "", stripped).otherwise(worded)).drop("_text")


def model_rewrite(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Take the rewrite of a model, ``answer`` = ``{"query": "..."}``.

    Rejected when empty or when it names a provider the question does not;
    providers it lost are appended. Rejected rows use the offline rewrite.
    """
    payload = _object(F.col("answer"))
    proposal = F.coalesce(
        T.blank_to_null(F.try_variant_get(payload, "$.query", "string")),
        T.blank_to_null(F.try_variant_get(payload, "$.rewritten", "string")),
        F.lit(""),
    )
    offline = rewrite(queries, catalog, to="_offline")
    asked = match_providers(offline, catalog.aliases, to="_asked").withColumn("_text", _tidy(T.strip(proposal)))
    produced = match_providers(asked, catalog.aliases, "_text", "_produced")
    named = canonicalize(produced, catalog.aliases, "_text")
    kept = match_providers(named, catalog.aliases, "_text", "_kept")
    good = (
        (F.col("_text") != "")
        & ~T.is_blank(F.col("query"))
        & (F.size(F.array_except("_produced", "_asked")) == 0)
    )
    missing = F.array_except("_asked", "_kept")
    text = T.strip(F.concat_ws(" ", "_text", T.blank_to_null(F.array_join(missing, " "))))
    return kept.withColumn("rewritten", F.when(good, text).otherwise(F.col("_offline"))).drop(
        "_offline", "_asked", "_text", "_produced", "_kept"
    )


def decomposed(providers: Column, topics: Column, rewritten: Column) -> Column:
    """"provider topic" for every topic and provider, topics outermost, if there are
    at least two providers and a topic; else the rewrite alone."""
    pairs = F.flatten(
        F.transform(topics, lambda t: F.transform(providers, lambda p: F.concat_ws(" ", p, t)))
    )
    return F.when((F.size(providers) >= 2) & (F.size(topics) > 0), pairs).otherwise(F.array(rewritten))


def expanded(parts: Column, kind: Column) -> Column:
    """The parts if there are several; else the rewrite and the alternate of its kind."""
    rewritten = F.get(parts, F.lit(0))
    alternate = reduce(
        lambda acc, k: acc.when(kind == k, F.array(F.concat_ws(" ", rewritten, F.lit(ALTERNATES[k])))),
        ALTERNATES,
        F.when(F.lit(False), _none()),
    ).otherwise(_none())
    both = T.unique_ignoring_case(F.concat(F.array(rewritten), alternate))
    return F.when(F.size(parts) > 1, parts).otherwise(both)


def expand_queries(extracted: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``parts`` (decomposition) and ``queries`` (what is searched)."""
    named = match_providers(extracted, catalog.aliases, "rewritten", "_named")
    providers = F.when(F.size("providers") > 0, F.col("providers")).otherwise(F.col("_named"))
    return (
        named.withColumn("parts", decomposed(providers, F.col("topics"), F.col("rewritten")))
        .withColumn("queries", expanded(F.col("parts"), F.col("kind")))
        .drop("_named")
    )


def inferred_filters(providers: Column, kind: Column | None) -> dict[str, Column]:
    """Provider filter if exactly one is named. With a kind, reviews look among
    reviews, and a single provider among provider pages."""
    provider = F.when(F.size(providers) == 1, F.get(providers, F.lit(0)))
    content_type = F.lit(None).cast("string")
    if kind is not None:
        content_type = F.when(kind == "review", F.lit("review")).when(provider.isNotNull(), F.lit("provider"))
    return {"filter_provider": provider, "filter_content_type": content_type}


def merged_filters(queries: DataFrame, inferred: dict[str, Column], infer: Column | bool = True) -> DataFrame:
    """Explicit filters win field by field over the inferred ones."""
    use = F.lit(infer) if isinstance(infer, bool) else infer
    merged = {}
    for name in ("filter_provider", "filter_content_type", "filter_document_id", SECTION_HINT):
        explicit = F.col(name) if name in queries.columns else F.lit(None).cast("string")
        guess = F.when(use, inferred[name]) if name in inferred else F.lit(None).cast("string")
        merged[name] = F.coalesce(explicit, guess)
    return queries.withColumns(merged)


def infer_from_catalog(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Filters for a search without extraction: the provider, if exactly one is named."""
    named = match_providers(queries, catalog.aliases, to="_named")
    return merged_filters(named, inferred_filters(F.col("_named"), None)).drop("_named")


def preprocess(queries: DataFrame, catalog: Catalog, answers: DataFrame | None = None) -> DataFrame:
    """Kind, providers, topics, rewrite, sub-queries and filters of every question.

    ``queries`` may hold ``infer`` and explicit filters; ``answers(query_id,
    answer)`` are extractions of a model.
    """
    if answers is None:
        extracted = heuristic_extraction(queries, catalog)
    else:
        asked = queries.join(answers, "query_id", "left")
        extracted = model_extraction(asked, catalog).drop("answer")
    expanded_rows = expand_queries(rewrite(extracted, catalog), catalog)
    infer = F.coalesce(F.col("infer"), F.lit(True)) if "infer" in queries.columns else True
    inferred = inferred_filters(F.col("providers"), F.col("kind"))
    return merged_filters(expanded_rows, inferred, infer)


def follow_up_queries(question: Column, plain_rewrite: Column, providers: Column, first: Column) -> Column:
    """Broader queries for a second pass: the question, its plain rewrite and the
    provider names, without those of the first pass; the question if none is left."""
    asked = T.strip(question)
    tried = F.transform(first, F.lower)
    fresh = F.filter(
        T.unique_ignoring_case(F.concat(F.array(asked, plain_rewrite), providers)),
        lambda q: (q != "") & ~F.array_contains(tried, F.lower(q)),
    )
    return F.when(F.size(fresh) > 0, fresh).otherwise(F.array(asked))

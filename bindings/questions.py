"""Question understanding over names from ``part``; answers over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from bindings.search import sparse
from gleaner.functions import text as T
from gleaner.operators import answers as A
from gleaner.operators import catalog as K
from gleaner.operators import evidence as EV
from gleaner.operators import lexical as L
from gleaner.operators import questions as Q
from gleaner.plans import answering as P
from gleaner.session import cut_lineage


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def part_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a provider page; odd-length names in camel case."""
    spaced = F.initcap("p_name")
    name = F.when(F.length("p_name") % 2 == 1, F.replace(spaced, F.lit(" "), F.lit(""))).otherwise(spaced)
    return B.table(spark, sf, "part").select(
        F.lit("provider").alias("content_type"),
        F.col("p_partkey").cast("string").alias("document_id"),
        F.lit(0).alias("chunk_no"),
        name.alias("provider"),
        F.col("p_type").alias("title"),
        F.col("p_brand").alias("section"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_name")).alias("text"),
    )


def part_catalog(spark: SparkSession, sf: str) -> K.Catalog:
    return K.catalog_from_chunks(part_chunks(spark, sf))


def part_questions(spark: SparkSession, sf: str) -> DataFrame:
    name, form = F.col("p_name"), F.col("p_size") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("Can you tell me how much "), name, F.lit(" costs?")))
        .when(
            form == 1,
            F.concat(
                F.lit("please explain  "), F.upper(F.replace(name, F.lit(" "), F.lit(""))), F.lit(" of "),
                F.col("p_brand"), F.lit(" ??"),
            ),
        )
        .when(form == 2, F.concat(F.lit("compare "), name, F.lit(" and Blue Anvil prices")))
        .when(form == 3, F.concat(F.lit("What do customers say about "), F.initcap(name), F.lit("?")))
        .when(form == 4, F.concat(name, F.lit("s and old")))
        .otherwise(F.lit("  ?? "))
    )
    n = F.col("p_partkey") % 7
    answer = (
        F.when(
            n == 0,
            F.concat(
                F.lit('{"kind": "pricing", "providers": ["'), F.upper(name),
                F.lit('"], "topics": ["economy", "golf", "economy"]}'),
            ),
        )
        .when(
            n == 1,
            F.concat(
                F.lit('{"kind": "comparison", "providers": ["blue anvil", "nobody", "'), name,
                F.lit('"], "topics": ["Standard size", "promo"]}'),
            ),
        )
        .when(n == 2, F.lit("not json"))
        .when(n == 3, F.lit('{"kind": "banter", "topics": []}'))
        .when(n == 4, F.lit('{"kind": "review"}'))
        .when(n == 5, F.lit('{"kind": "factual", "providers": null}'))
        .otherwise(F.lit("[1, 2]"))
    )
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), text.alias("query"), answer.alias("answer")
    )


def catalog_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return part_catalog(spark, sf).aliases.select("needle", "name")


def catalog_headings(spark: SparkSession, sf: str) -> DataFrame:
    headings = part_catalog(spark, sf).headings
    return headings.select("heading", F.col("first.document_id").alias("first_document"))


def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = K.match_providers(part_questions(spark, sf), part_catalog(spark, sf).aliases)
    return asked.select("query_id", joined("providers"))


def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    asked = part_questions(spark, sf).select("query_id", F.col("query").alias("text"))
    return K.canonicalize(asked, part_catalog(spark, sf).aliases)


def topic_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer segment, passage and turn as a topic, tested against all documents."""
    segments = B.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("topic"))
    texts = B.table(spark, sf, "benchmark").select(F.col("text").alias("topic"))
    turns = B.table(spark, sf, "conversations").select(F.col("text").alias("topic"))
    corpus = B.table(spark, sf, "documents").select(F.lower("text").alias("text"))
    catalog = K.Catalog(segments, segments, segments, corpus)
    return K.grounded_topics(segments.unionByName(texts).unionByName(turns), catalog)


def extraction_intake(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.model_extraction(part_questions(spark, sf), part_catalog(spark, sf))
    return rows.select("query_id", "kind", joined("providers"), joined("topics"), "source")


def rewrite(spark: SparkSession, sf: str) -> DataFrame:
    catalog = part_catalog(spark, sf)
    kind = F.when(F.col("query_id") % 4 == 0, "pricing").when(F.col("query_id") % 4 == 1, "review").when(
        F.col("query_id") % 4 == 2, "comparison"
    ).otherwise("factual")
    rows = Q.rewrite(part_questions(spark, sf).withColumn("kind", kind), catalog)
    return rows.select("query_id", "kind", "rewritten")


def model_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Rewrites proposed by a model: usable, with a provider nobody asked about,
    without the one asked about, empty, and no JSON at all."""
    name, n = F.initcap("p_name"), F.col("p_partkey") % 5
    proposals = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.when(n == 0, F.concat(F.lit('{"query": "'), name, F.lit('  pricing ?"}')))
        .when(n == 1, F.lit('{"query": "blue anvil"}'))
        .when(n == 2, F.lit("oops"))
        .when(n == 3, F.lit('{"rewritten": "plans and rates"}'))
        .otherwise(F.lit('{"query": " ? "}')).alias("answer"),
    )
    kind = F.when(F.col("query_id") % 2 == 0, "pricing").otherwise("factual")
    asked = part_questions(spark, sf).drop("answer").withColumn("kind", kind)
    rows = Q.model_rewrite(asked.join(proposals, "query_id"), part_catalog(spark, sf))
    return rows.select("query_id", "rewritten")


def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction, rewrite, decomposition, expansion and inferred filters."""
    asked = part_questions(spark, sf)
    rows = P.inspect_preprocess(
        asked.drop("answer"), part_catalog(spark, sf), asked.select("query_id", "answer")
    )
    return rows.select(
        "query_id", "kind", joined("providers"), joined("topics"), "rewritten", joined("queries"),
        F.coalesce("filters.provider", F.lit("-")).alias("filter_provider"),
        F.coalesce("filters.content_type", F.lit("-")).alias("filter_content_type"),
    )


def filter_merge_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Explicit filters from customers, inferred ones from their segment."""
    rows = B.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("filter_provider"),
        F.when(F.col("c_nationkey") % 5 == 0, F.lit("article")).alias("filter_content_type"),
        F.when(F.col("c_acctbal") > 0, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment")).alias("providers"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("review")).otherwise(F.lit("pricing")).alias("kind"),
    )
    merged = Q.merged_filters(rows, Q.inferred_filters(F.col("providers"), F.col("kind")))
    show = {c: F.coalesce(F.col(c), F.lit("-")) for c in ("filter_provider", "filter_content_type")}
    return merged.withColumns(show).select("query_id", *show)


def filter_infer_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.infer_from_catalog(part_questions(spark, sf), part_catalog(spark, sf))
    return rows.select(
        "query_id", F.coalesce("filter_provider", F.lit("-")).alias("filter_provider"),
        F.coalesce("filter_content_type", F.lit("-")).alias("filter_content_type"),
    )


def sourced_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages that name their source; every other one infers filters."""
    n = F.col("query_id")
    return B.questions(spark, sf).select(
        "query_id",
        F.concat("query", F.lit(" in SRC"), (n % 20).cast("string"), F.lit("?")).alias("query"),
        (n % 2 == 0).alias("infer"),
        F.when(n % 3 == 0, F.lit("nowhere")).when(n % 3 == 1, F.lit("doc 1")).alias("filter_section"),
    )


def _corrected(spark: SparkSession, sf: str) -> P.Corrected:
    chunks = cut_lineage(B.fixed_chunks(spark, sf))
    catalog = K.catalog_from_chunks(chunks)
    prepared = Q.preprocess(sourced_questions(spark, sf), catalog)
    search = L.retriever(chunks, L.materialized(L.build_index(chunks)))
    return P.retrieve_with_correction(prepared, search, catalog)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.questions(spark, sf)
    rows = EV.verdicts(asked, sparse(spark, sf)(asked), min_overlap=0.8)
    return rows.select("query_id", "sufficient", "reason", B.rounded("overlap").alias("overlap"))


def evidence_model(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of a model where it gave a usable one."""
    n = F.col("query_id") % 4
    said = (
        F.when(n == 0, F.lit('{"sufficient": true, "reason": "fine"}'))
        .when(n == 1, F.lit('{"sufficient": false}'))
        .when(n == 2, F.lit("no json"))
    )
    asked = B.questions(spark, sf).withColumn("answer", said)
    rows = EV.verdicts(asked, sparse(spark, sf)(B.questions(spark, sf)), min_overlap=0.8)
    return rows.select("query_id", "sufficient", "reason", B.rounded("overlap").alias("overlap"))


def evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """The report of answers, abstentions and evidence."""
    corrected = _corrected(spark, sf)
    rows = P.inspect_evidence(P.respond(corrected.outcome, corrected.hits, "sparse"))
    return rows.select(
        "query_id", "answer", "abstained", F.col("evidence.reason").alias("reason"), F.col("evidence.retried").alias("retried")
    )


def corrective(spark: SparkSession, sf: str) -> DataFrame:
    return _corrected(spark, sf).attempts.select(
        "query_id", "attempt", joined("queries"), joined("chunk_ids"), "sufficient", "reason",
        B.rounded("overlap").alias("overlap"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    corrected = _corrected(spark, sf)
    rows = P.respond(corrected.outcome, corrected.hits, "sparse")
    listed = F.transform("sources", lambda s: F.concat_ws("~", s["title"], s["section"], s["url"]))
    return rows.select(
        "query_id", "answer", F.array_join(listed, "|").alias("sources"), "strategy",
        F.coalesce("filters.section", F.lit("-")).alias("section"),
        F.array_join("preprocess.queries", "|").alias("queries"),
        F.col("evidence.reason").alias("reason"), F.col("evidence.retried").alias("retried"),
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.questions(spark, sf)
    rows = A.grounded_answers(asked, sparse(spark, sf)(asked))
    return rows.select(
        "query_id", F.md5("context").alias("context_md5"),
        F.md5(A.user_prompt(F.col("query"), F.col("context"))).alias("prompt_md5"), F.md5("answer").alias("answer_md5"),
    )


def citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.citations(sparse(spark, sf)(B.questions(spark, sf), 20))
    exploded = rows.select("query_id", F.posexplode("sources").alias("pos", "s"))
    return exploded.select("query_id", "pos", "s.title", "s.section", "s.url")


QUERIES = {
    "catalog_aliases": catalog_aliases,
    "catalog_headings": catalog_headings,
    "alias_match": alias_match,
    "canonicalize": canonicalize,
    "topic_grounding": topic_grounding,
    "extraction_intake": extraction_intake,
    "rewrite": rewrite,
    "model_rewrite": model_rewrite,
    "preprocess": preprocess,
    "filter_merge_infer": filter_merge_infer,
    "filter_infer_catalog": filter_infer_catalog,
    "evidence": evidence,
    "evidence_model": evidence_model,
    "evidence_table": evidence_table,
    "corrective": corrective,
    "answers": answers,
    "context": context,
    "citations": citations,
}

CAP = "(upper(left(split_part(p_name, ' ', {0}), 1)) || substr(split_part(p_name, ' ', {0}), 2))"
NAMES = f"""
named AS (
  SELECT *, {CAP.format(1)} || ' ' || {CAP.format(2)} AS spaced,
    {CAP.format(1)} || (CASE WHEN length(p_name) % 2 = 1 THEN '' ELSE ' ' END) || {CAP.format(2)} AS name
  FROM part
),
names AS (SELECT DISTINCT name FROM named),
aliases AS (
  SELECT DISTINCT name, unnest([lower(name), replace(lower(name), ' ', ''),
         lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'))]) AS needle FROM names
)"""

ASKED = """
asked AS (
  SELECT p_partkey AS query_id, p_partkey % 7 AS n, name, p_name,
    CASE p_size % 6
      WHEN 0 THEN 'Can you tell me how much ' || p_name || ' costs?'
      WHEN 1 THEN 'please explain  ' || upper(replace(p_name, ' ', '')) || ' of ' || p_brand || ' ??'
      WHEN 2 THEN 'compare ' || p_name || ' and Blue Anvil prices'
      WHEN 3 THEN 'What do customers say about ' || spaced || '?'
      WHEN 4 THEN p_name || 's and old'
      ELSE '  ?? ' END AS query
  FROM named
)"""


def mention_sql(source: str, text: str, out: str, column: str) -> str:
    return f"""
{out} AS (
  SELECT s.*, coalesce(m.found, []::VARCHAR[]) AS {column} FROM {source} s LEFT JOIN (
    SELECT query_id, list(name ORDER BY -l, name) AS found FROM (
      SELECT query_id, a.name, max(length(needle)) AS l
      FROM {source} q JOIN aliases a ON regexp_matches(lower({text}), '\\b' || regexp_escape(needle) || '\\b') GROUP BY ALL)
    GROUP BY query_id) m USING (query_id)
)"""


def canonical_sql(text: str) -> str:
    return f"""list_reduce(list_concat([{{'needle': {text}, 'name': ''}}],
      (SELECT list({{'needle': needle, 'name': name}} ORDER BY -length(needle), name, needle) FROM aliases)),
    lambda a, x: {{'needle': regexp_replace(a.needle, '(?i)\\b' || regexp_escape(x.needle) || '\\b', x.name, 'g'), 'name': ''}}).needle"""


FILLER = r"(?i)^(please\s+)?(can you|could you|would you)?\s*(tell me|explain|i (want|need|would like) to know)\s+"
TIDY = f"trim(regexp_replace(regexp_replace(trim(query), '{FILLER}', ''), '\\s+', ' ', 'g'), ' ?')"


def worded_sql(text: str, kind: str) -> str:
    def add(term: str) -> str:
        return f"(CASE WHEN contains(lower({text}), '{term}') THEN '' ELSE ' {term}' END)"

    return f"""CASE WHEN {text} = '' THEN trim(query) WHEN {kind} = 'pricing' THEN {text} || {add("pricing")} || {add("cost")}
      WHEN {kind} = 'review' THEN {text} || {add("reviews")} WHEN {kind} = 'comparison' THEN {text} || {add("compare")} ELSE {text} END"""


# Whether the corpus holds the topics used above does not depend on the question.
EXTRACTED = f"""
{mention_sql("asked", "query", "mentions", "said")},
topics AS (
  SELECT t, EXISTS (SELECT 1 FROM part WHERE contains(lower(p_type || chr(10) || p_brand || chr(10) || 'size ' || p_size || ' of ' || p_name), lower(t)))
      OR (len(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda w: len(w) > 3)) > 0 AND NOT EXISTS (
        SELECT 1 FROM (SELECT unnest(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda w: len(w) > 3)) AS w)
        WHERE NOT EXISTS (SELECT 1 FROM part WHERE contains(lower(p_type || chr(10) || p_brand || chr(10) || 'size ' || p_size || ' of ' || p_name), w)))) AS ok
  FROM (SELECT unnest(['economy', 'golf', 'Standard size', 'promo']) AS t)
),
wanted AS (
  SELECT *, n IN (0, 1, 4) AS good,
    CASE n WHEN 0 THEN ['economy', 'golf'] WHEN 1 THEN ['Standard size', 'promo'] ELSE []::VARCHAR[] END AS ts,
    CASE n WHEN 0 THEN [lower(p_name)] WHEN 1 THEN ['blue anvil', 'nobody', lower(p_name)] ELSE []::VARCHAR[] END AS ps,
    (SELECT list(t) FROM topics WHERE ok) AS known_topics
  FROM mentions
),
kept AS (
  SELECT *, list_distinct(list_filter(list_transform(ps, lambda p: list_filter(said, lambda m: lower(m) = p)[1]),
                        lambda m: m IS NOT NULL)) AS known_raw,
    list_filter(ts, lambda t: list_contains(known_topics, t)) AS topics
  FROM wanted
),
extracted AS (
  SELECT query_id, query, topics,
    CASE WHEN n = 0 THEN 'pricing' WHEN n = 1 THEN 'comparison' WHEN n = 4 THEN 'review' ELSE 'factual' END AS kind,
    CASE WHEN good THEN 'openai' ELSE 'heuristic' END AS source,
    CASE WHEN good AND len(known_raw) > 0
      THEN list_filter(list_transform(ps, lambda p, i: CASE WHEN list_position(ps, p) = i THEN list_filter(said, lambda m: lower(m) = p)[1] END),
                       lambda m: m IS NOT NULL)
      ELSE said END AS providers
  FROM kept
)"""

HEAD = f"WITH {NAMES}, {ASKED}"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ({STOPS})))"
BASE = f"WITH {B.DOCS}, {B.FIXED}, {B.QUESTIONS}"
HITS = f"{BASE}, {B.bm25_sql()}, {B.ranked_sql('scored', 5, 'top')}"
PASSAGE = """'[' || rank || '] Title: ' || title || ' | Section: ' || section || ' | URL: ' || url || chr(10) || trim(text, E' \\n\\t')"""
SENTENCE = """coalesce(nullif(regexp_extract({0}, '(?s)^(.*?[.!?])(?:\\s|$)', 1), ''), string_split({0}, chr(10) || chr(10))[1])"""


def attempt_sql(no: int, subs: str, asked: str, prefix: str) -> str:
    """CTEs of one pass: search, fuse, judge. ``subs(query_id, qid, list_no, n, query, fp, fc, hint)``."""
    p = prefix
    scored = B.bm25_sql(questions=subs, prefix=p).replace("FROM qt ", f"FROM {p}qt ")
    scored = scored.replace(f"FROM {p}qt JOIN df USING", f"FROM {p}qt JOIN {p}df USING")
    return f"""{scored},
{p}flagged AS (
  SELECT s.*, r.hint IS NULL OR contains(lower(f.section), r.hint) AS m
  FROM {p}scored s JOIN fixed f USING (content_type, document_id, chunk_no) JOIN {subs} r USING (query_id)
  WHERE (r.fp IS NULL OR f.provider = r.fp) AND (r.fc IS NULL OR f.content_type = r.fc)
),
{p}kept AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY query_id) AS any_m FROM {p}flagged) WHERE m OR NOT any_m),
{B.ranked_sql(f"{p}kept", 5, f"{p}each")},
{p}fused AS (
  SELECT qid, content_type, document_id, chunk_no, sum(1.0::DOUBLE / (60 + rank)) AS fs, min(list_no * 1000 + rank) AS seen
  FROM {p}each JOIN {subs} USING (query_id) GROUP BY ALL
),
{p}hits AS (
  SELECT * FROM (SELECT qid AS query_id, f.*, row_number() OVER (PARTITION BY qid ORDER BY round(fs, 12) DESC, seen) AS rank
    FROM {p}fused JOIN fixed f USING (content_type, document_id, chunk_no)) WHERE rank <= 5
),
{p}found AS (SELECT query_id, count(*) AS n, list_distinct(flatten(list({TERMS.format("title || ' ' || section || ' ' || text")}))) AS terms,
       string_agg(id, '|' ORDER BY rank) AS ids FROM {p}hits GROUP BY 1),
{p}judged AS (
  SELECT a.*, coalesce(ids, '') AS ids, coalesce(n, 0) AS n_hits, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE
    len(list_intersect({TERMS.format("query")}, terms)) / len({TERMS.format("query")})::DOUBLE END AS overlap
  FROM {asked} a LEFT JOIN {p}found USING (query_id)
),
{p}verdict AS (SELECT *, n_hits > 0 AND overlap >= 0.3 AS sufficient,
   CASE WHEN n_hits = 0 THEN 'no_hits' WHEN overlap < 0.3 THEN 'low_overlap' ELSE 'ok' END AS reason FROM {p}judged)"""


CORRECTIVE = f"""WITH {B.DOCS}, {B.FIXED},
prepared AS (
  SELECT item_id AS query_id, text || ' in SRC' || (item_id % 20) || '?' AS query,
    trim(regexp_replace(trim(text || ' in src' || (item_id % 20)), '\\s+', ' ', 'g'), ' ?') AS rewritten,
    'src' || (item_id % 20) AS provider, item_id % 2 = 0 AS infer,
    CASE item_id % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'doc 1' END AS hint
  FROM benchmark
),
subs1 AS (SELECT query_id, query_id AS qid, 0 AS list_no, rewritten AS query, CASE WHEN infer THEN provider END AS fp,
                 CASE WHEN infer THEN 'provider' END AS fc, hint FROM prepared),
{attempt_sql(1, "subs1", "prepared", "a_")},
thin AS (SELECT *, list_filter([trim(query), rewritten, provider], lambda x: lower(x) <> lower(rewritten)) AS retry
         FROM a_verdict WHERE NOT sufficient),
asked2 AS (SELECT query_id, query, rewritten, provider, infer, retry FROM thin),
subs2 AS (SELECT query_id * 1000 + i AS query_id, query_id AS qid, i AS list_no, retry[i] AS query,
   CASE WHEN infer THEN provider END AS fp, CASE WHEN infer THEN 'provider' END AS fc, NULL::VARCHAR AS hint
   FROM (SELECT *, unnest(range(1, len(retry) + 1)) AS i FROM asked2)),
{attempt_sql(2, "subs2", "asked2", "b_")}"""

ORACLE = {
    "catalog_aliases": f"WITH {NAMES} SELECT needle, name FROM aliases",
    "catalog_headings": "SELECT p_brand AS heading, min(CAST(p_partkey AS VARCHAR)) AS first_document FROM part GROUP BY 1",
    "alias_match": f"{HEAD}, {mention_sql('asked', 'query', 'm', 'found')} SELECT query_id, array_to_string(found, '|') AS providers FROM m",
    "canonicalize": f"{HEAD} SELECT query_id, {canonical_sql('query')} AS text FROM asked",
    "topic_grounding": """WITH topics AS (
  SELECT c_mktsegment AS topic FROM customer UNION SELECT text FROM benchmark
  UNION SELECT text FROM conversations
),
parts AS (
  SELECT topic, trim(lower(topic), E' \\n\\t') AS needle, true AS whole FROM topics
  UNION
  SELECT topic, unnest(list_filter(regexp_extract_all(lower(topic), '[a-z0-9]+'), lambda w: len(w) > 3)), false FROM topics
),
found AS (
  SELECT needle, bool_or(contains(lower(d.text), needle)) AS hit FROM (SELECT DISTINCT needle FROM parts WHERE needle <> ''), documents d GROUP BY 1
)
SELECT topic, coalesce(bool_or(whole AND hit), false) OR coalesce(bool_and(CASE WHEN NOT whole THEN hit END), false) AS allowed
FROM parts LEFT JOIN found USING (needle) GROUP BY 1""",
    "extraction_intake": f"""{HEAD}, {EXTRACTED}
SELECT query_id, kind, array_to_string(providers, '|') AS providers, array_to_string(topics, '|') AS topics, source FROM extracted""",
    "rewrite": f"""{HEAD},
tidy AS (
  SELECT query_id, query, CASE query_id % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'review' WHEN 2 THEN 'comparison' ELSE 'factual' END AS kind,
         {canonical_sql(TIDY)} AS t FROM asked
)
SELECT query_id, kind, {worded_sql("t", "kind")} AS rewritten FROM tidy""",
    "model_rewrite": f"""{HEAD},
offered AS (
  SELECT query_id, query, CASE WHEN query_id % 2 = 0 THEN 'pricing' ELSE 'factual' END AS kind,
    CASE query_id % 5 WHEN 0 THEN spaced || ' pricing' WHEN 1 THEN 'blue anvil' WHEN 3 THEN 'plans and rates' ELSE '' END AS proposal
  FROM asked JOIN (SELECT p_partkey AS query_id, spaced FROM named) USING (query_id)
),
{mention_sql("offered", "query", "o_said", "said")},
{mention_sql("o_said", "proposal", "o_produced", "produced")},
o_named AS (SELECT *, {canonical_sql("proposal")} AS t, {canonical_sql(TIDY)} AS tidied FROM o_produced),
{mention_sql("o_named", "t", "o_kept", "kept")},
offline AS (SELECT *, {worded_sql("tidied", "kind")} AS plain, list_filter(said, lambda s: NOT list_contains(kept, s)) AS missing FROM o_kept)
SELECT query_id, CASE WHEN t <> '' AND len(list_filter(produced, lambda p: NOT list_contains(said, p))) = 0
  THEN t || CASE WHEN len(missing) > 0 THEN ' ' || array_to_string(missing, ' ') ELSE '' END ELSE plain END AS rewritten
FROM offline""",
    "preprocess": f"""{HEAD}, {EXTRACTED},
tidy AS (SELECT *, {canonical_sql(TIDY)} AS t FROM extracted),
rewritten AS (SELECT *, {worded_sql("t", "kind")} AS r FROM tidy),
parted AS (
  SELECT *, CASE WHEN len(providers) >= 2 AND len(topics) > 0
    THEN flatten(list_transform(topics, lambda t: list_transform(providers, lambda p: p || ' ' || t))) ELSE [r] END AS parts
  FROM rewritten
)
SELECT query_id, kind, array_to_string(providers, '|') AS providers, array_to_string(topics, '|') AS topics, r AS rewritten,
  array_to_string(CASE WHEN len(parts) > 1 THEN parts WHEN kind = 'pricing' THEN [r, r || ' plans per user']
    WHEN kind = 'review' THEN [r, r || ' customer support'] ELSE [r] END, '|') AS queries,
  CASE WHEN len(providers) = 1 THEN providers[1] ELSE '-' END AS filter_provider,
  CASE WHEN kind = 'review' THEN 'review' WHEN len(providers) = 1 THEN 'provider' ELSE '-' END AS filter_content_type
FROM parted""",
    "filter_infer_catalog": f"""{HEAD}, {mention_sql('asked', 'query', 'm', 'found')}
SELECT query_id, CASE WHEN len(found) = 1 THEN found[1] ELSE '-' END AS filter_provider, '-' AS filter_content_type FROM m""",
    "filter_merge_infer": """SELECT c_custkey AS query_id,
  coalesce(CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_acctbal > 0 THEN c_name END, '-') AS filter_provider,
  coalesce(CASE WHEN c_nationkey % 5 = 0 THEN 'article' END, CASE WHEN c_nationkey % 2 = 0 THEN 'review' END,
           CASE WHEN c_acctbal > 0 THEN 'provider' END, '-') AS filter_content_type FROM customer""",
    "evidence": f"""{HITS},
found AS (SELECT query_id, list_distinct(flatten(list({TERMS.format("title || ' ' || section || ' ' || text")}))) AS terms
          FROM top JOIN fixed USING (content_type, document_id, chunk_no) GROUP BY 1),
judged AS (SELECT query_id, CASE WHEN terms IS NULL THEN 0 ELSE len(list_intersect({TERMS.format("query")}, terms)) / len({TERMS.format("query")})::DOUBLE END AS overlap,
           terms IS NULL AS nothing FROM questions LEFT JOIN found USING (query_id))
SELECT query_id, NOT nothing AND overlap >= 0.8 AS sufficient,
  CASE WHEN nothing THEN 'no_hits' WHEN overlap < 0.8 THEN 'low_overlap' ELSE 'ok' END AS reason, round(overlap, 6) AS overlap FROM judged""",
    "corrective": f"""{CORRECTIVE}
SELECT query_id, 1 AS attempt, rewritten AS queries, ids AS chunk_ids, sufficient, reason, round(overlap, 6) AS overlap FROM a_verdict
UNION ALL
SELECT query_id, 2, array_to_string(retry, '|'), ids, sufficient, reason, round(overlap, 6) FROM b_verdict""",
    "answers": f"""{CORRECTIVE},
final AS (
  SELECT query_id, query, rewritten AS queries, sufficient, reason, false AS retried, hint FROM a_verdict WHERE sufficient
  UNION ALL
  SELECT query_id, query, rewritten || '|' || array_to_string(retry, '|'), sufficient, reason, true, NULL FROM b_verdict
),
hits AS (SELECT a_hits.* FROM a_hits JOIN a_verdict USING (query_id) WHERE sufficient UNION ALL SELECT * FROM b_hits),
texts AS (
  SELECT query_id, max(CASE WHEN rank = 1 THEN {SENTENCE.format("trim(text, E' \\n\\t')")} END) AS answer
  FROM hits GROUP BY 1
),
cites AS (
  SELECT query_id, string_agg(title || '~' || section || '~' || url, '|' ORDER BY r) AS sources
  FROM (SELECT query_id, title, section, url, min(rank) AS r FROM hits GROUP BY ALL) GROUP BY 1
)
SELECT query_id, CASE WHEN sufficient THEN answer ELSE '{A.ABSTAIN_MESSAGE}' END AS answer,
  CASE WHEN sufficient THEN sources ELSE '' END AS sources, 'sparse' AS strategy, coalesce(hint, '-') AS section,
  queries, reason, retried
FROM final LEFT JOIN texts USING (query_id) LEFT JOIN cites USING (query_id)""",
    "context": f"""{HITS},
packed AS (
  SELECT query_id, string_agg({PASSAGE}, chr(10) || chr(10) ORDER BY rank) AS context,
         max(CASE WHEN rank = 1 THEN trim(text, E' \\n\\t') END) AS best
  FROM top JOIN fixed USING (content_type, document_id, chunk_no) GROUP BY 1
)
SELECT query_id, md5(coalesce(context, '')) AS context_md5,
  md5('Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '{A.NO_CONTEXT}')) AS prompt_md5,
  md5(coalesce({SENTENCE.format("best")}, '')) AS answer_md5
FROM questions LEFT JOIN packed USING (query_id)""",
    "citations": f"""{BASE}, {B.bm25_sql()}, {B.ranked_sql('scored', 20, 'top')},
firsts AS (SELECT query_id, title, section, url, min(rank) AS r FROM top JOIN fixed USING (content_type, document_id, chunk_no) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS pos, title, section, url FROM firsts""",
}

ORACLE["evidence_model"] = f"""SELECT query_id, CASE WHEN reason = 'no_hits' THEN sufficient WHEN query_id % 4 = 0 THEN true
  WHEN query_id % 4 = 1 THEN false ELSE sufficient END AS sufficient,
  CASE WHEN reason = 'no_hits' THEN reason WHEN query_id % 4 = 0 THEN 'fine' WHEN query_id % 4 = 1 THEN 'ok' ELSE reason END AS reason, overlap
FROM ({ORACLE["evidence"]})"""
ORACLE["evidence_table"] = f"""SELECT query_id, answer, answer = '{A.ABSTAIN_MESSAGE}' AS abstained, reason, retried FROM ({ORACLE["answers"]})"""

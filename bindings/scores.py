"""Evaluation: benchmark passages as cases, the documents that contain them as relevant."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindings import base as B
from bindings.chunks import CHILDREN, DIMS, STRUCTURED
from bindings.questions import PASSAGE, SENTENCE
from bindings.search import DENSE, HASHED, LEX, fused_sql, sparse, stored
from gleaner.operators import answers as A
from gleaner.operators import contains
from gleaner.operators import evaluation as EV
from gleaner.plans import comparison as CO
from gleaner.operators.embedding import hashing_embedder
from gleaner.plans.retrieval import chunker_retrievers, strategy_hits
from gleaner.session import new_folder


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.questions(spark, sf).withColumnRenamed("query", "needle")
    texts = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    found = contains.occurrences(texts, asked.select("needle"), ["document_id"])
    return asked.join(found, "needle").select("query_id", "document_id")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that occur somewhere are factual cases, the others unanswerable ones."""
    expected = relevant(spark, sf).groupBy("query_id").agg(
        F.array_sort(F.collect_list("document_id")).alias("expected_documents")
    )
    joined = B.questions(spark, sf).join(expected, "query_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("query_id").alias("id"),
        F.col("query").alias("question"),
        F.coalesce("expected_documents", none).alias("expected_documents"),
        F.when(F.col("query_id") % 2 == 0, F.col("query")).alias("expected_answer"),
        F.when(F.col("expected_documents").isNull(), "unanswerable").otherwise("factual").alias("category"),
    )


def shown(scores: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in scores.columns if c not in keys]
    return scores.select(*keys, *[B.rounded(c).alias(c) for c in names])


def eval_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return relevant(spark, sf)


def eval_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.questions(spark, sf)
    ranking = EV.document_ranking(sparse(spark, sf)(asked))
    scores = EV.retrieval_scores(ranking, asked.select("query_id"), relevant(spark, sf))
    show = {c: F.coalesce(B.rounded(c), F.lit(-1.0)) for c in ("recall_at_k", "ndcg_at_k")}
    return scores.select(
        "query_id", B.rounded("precision_at_k").alias("precision_at_k"),
        B.rounded("reciprocal_rank").alias("reciprocal_rank"), *[c.alias(n) for n, c in show.items()],
    )


def eval_means(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.questions(spark, sf)
    ranking = EV.document_ranking(sparse(spark, sf)(asked))
    scores = EV.retrieval_scores(ranking, asked.select("query_id"), relevant(spark, sf))
    return shown(EV.mean_retrieval(scores))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    near, lexical = stored(spark, sf)
    return CO.run_cases(cases(spark, sf), lambda asked, k: strategy_hits(asked, near, lexical, k))


def eval_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The four strategies side by side with answers, costs and means."""
    report, _ = CO.compare(_results(spark, sf))
    return shown(report, "variant", "case_count")


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison's report written as JSON, read back and cut to the printed table."""
    report, _ = CO.compare(_results(spark, sf))
    folder = new_folder(spark, "reports")
    CO.write_report(report, folder)
    back = spark.read.schema(CO.with_run_stamp(report).schema).json(folder)
    stamped = back.filter(F.to_timestamp("ran_at").isNotNull())
    return shown(EV.comparison_table(stamped), "variant")


def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """The four strategies with answers, by category."""
    _, by_category = CO.compare(_results(spark, sf))
    return shown(by_category, "variant", "category")


def eval_chunkers(spark: SparkSession, sf: str) -> DataFrame:
    """The three chunkers side by side, each with a collection of its own."""
    searches = chunker_retrievers(B.lined_documents(spark, sf), hashing_embedder(DIMS))
    results = CO.run_cases(cases(spark, sf), searches, generate=None)
    return shown(EV.category_report(results, "variant"), "variant", "category")


def eval_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A generator that fails for some questions: their retrieval scores stay."""
    near, lexical = stored(spark, sf)

    def answer(question: str, context: str) -> str:
        if len(question) % 3 == 0:
            raise ValueError("no model")
        return "an answer"

    results = CO.run_cases(cases(spark, sf), {"sparse": lexical}, generate=CO.guarded(answer))
    show = {c: F.coalesce(B.rounded(c), F.lit(-1.0)) for c in ("recall_at_k", "ndcg_at_k", "context_recall")}
    return results.select(
        F.col("id").alias("query_id"), F.coalesce("error", F.lit("-")).alias("error"),
        *[B.rounded(c).alias(c) for c in ("precision_at_k", "reciprocal_rank", "context_precision")],
        *[c.alias(n) for n, c in show.items()],
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn as the answer to the user turn before it; the following
    assistant turn of the conversation, if any, as the expected answer."""
    turns = B.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (
        turns.withColumns(
            {"context": F.lag("text").over(w), "expected": F.lead("text").over(w), "before": F.lag("role").over(w)}
        )
        .filter("role = 'assistant' AND before = 'user'")
        .select(
            "conv_id", "turn", F.col("text").alias("answer"), "context", "expected",
            F.when(F.col("conv_id") % 3 == 0, "ambiguous").otherwise("factual").alias("category"),
        )
    )


def eval_generation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    scores = EV.generation_scores(F.col("answer"), F.col("context"), F.col("expected"), F.col("category"))
    return pairs.select("conv_id", "turn", *[B.rounded(c).alias(n) for n, c in scores.items()])


def refusals(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" I Do Not Know."))).otherwise(F.col("text"))
    return B.table(spark, sf, "conversations").select(
        "conv_id", "turn", EV.looks_like_refusal(answer).alias("refused")
    )


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measured cases: the hour is the variant, errors are failures."""
    value = F.col("value")
    tokens = {
        "embed_tokens": F.col("event_id") % 50,
        "llm_prompt_tokens": F.col("event_id") % 700,
        "llm_completion_tokens": F.col("user_id"),
    }
    return (
        B.table(spark, sf, "events")
        .withColumns(tokens)
        .withColumns(
            {
                "variant": F.date_format("ts", "HH"),
                "error": F.when(F.col("event_type") == "error", F.lit("failed")),
                "end_to_end_ms": value,
                "retrieval_ms": value / 2,
                "reranking_ms": F.lit(0.0),
                "llm_ms": value / 4,
                "cost_usd": EV.cost_usd(*[F.col(c) for c in tokens]),
            }
        )
    )


def engineering_means(spark: SparkSession, sf: str) -> DataFrame:
    return shown(EV.mean_engineering(_measured(spark, sf), "variant"), "variant")


def case_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _measured(spark, sf)
    return rows.select("event_id", B.rounded("cost_usd", 9).alias("cost_usd"))


def case_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The first three cases, and one by its id."""
    every = cases(spark, sf)
    picked = EV.select_cases(every, first=3).unionByName(EV.select_cases(every.filter("id = 7"), case_id="7"))
    return picked.select("id", "category")


QUERIES = {
    "eval_relevance": eval_relevance,
    "eval_retrieval": eval_retrieval,
    "eval_means": eval_means,
    "eval_compare": eval_compare,
    "eval_by_category": eval_by_category,
    "report_round_trip": report_round_trip,
    "eval_chunkers": eval_chunkers,
    "eval_failures": eval_failures,
    "eval_generation": eval_generation,
    "refusals": refusals,
    "case_selection": case_selection,
    "engineering_means": engineering_means,
    "case_costs": case_costs,
}

RELEVANT = """
relevant AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n_rel AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1)"""


def scores_sql(tops: dict[str, str]) -> str:
    """CTEs ending in ``case_scores(variant, query_id, n, recall_at_k, ...)`` for top-5 lists."""
    union = " UNION ALL ".join(
        f"SELECT '{v}' AS variant, query_id, document_id, rank FROM {t}" for v, t in tops.items()
    )
    variants = ", ".join(f"'{v}'" for v in tops)
    return f"""{RELEVANT},
docs_ranked AS (
  SELECT variant, query_id, document_id, row_number() OVER (PARTITION BY variant, query_id ORDER BY r) AS rank
  FROM (SELECT variant, query_id, document_id, min(rank) AS r FROM ({union}) GROUP BY ALL)
),
found AS (
  SELECT variant, query_id, count(*) FILTER (rank <= 5) AS hits, min(rank) AS best, sum(1 / log2(rank + 1)) FILTER (rank <= 5) AS dcg
  FROM docs_ranked JOIN relevant USING (query_id, document_id) GROUP BY ALL
),
case_scores AS (
  SELECT variant, q.query_id, query, coalesce(n, 0) AS n, coalesce(hits, 0) / n AS recall_at_k,
    coalesce(hits, 0) / 5.0::DOUBLE AS precision_at_k, coalesce(1.0::DOUBLE / best, 0) AS reciprocal_rank,
    CASE WHEN n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_k
  FROM questions q CROSS JOIN (SELECT unnest([{variants}]) AS variant) v
  LEFT JOIN n_rel USING (query_id) LEFT JOIN found USING (variant, query_id)
)"""


HEAD = f"WITH {B.DOCS}, {B.FIXED}, {B.QUESTIONS}, {B.bm25_sql()}"
TOP = B.ranked_sql("scored", 5, "top")
MEANS = """round(coalesce(avg(recall_at_k), 0), 6) AS recall_at_k, round(avg(precision_at_k), 6) AS precision_at_k,
  round(avg(reciprocal_rank), 6) AS mrr, round(coalesce(avg(ndcg_at_k), 0), 6) AS ndcg_at_k"""


def overlap_sql(a: str, b: str) -> str:
    left = f"list_distinct({B.TOKENS.format(a)})"
    return (
        f"(CASE WHEN len({left}) = 0 THEN 0 ELSE len(list_intersect({left}, list_distinct({B.TOKENS.format(b)})))"
        f" / len({left})::DOUBLE END)"
    )


REFUSED = " OR ".join("contains(lower({0}), '%s')" % m.replace("'", "''") for m in EV.REFUSAL_MARKERS)

RERANKED = f"""
reranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM (
    SELECT p.query_id, p.content_type, p.document_id, p.chunk_no, p.rank AS r0, {LEX} AS score
    FROM pool p JOIN fixed f USING (content_type, document_id, chunk_no) JOIN questions q USING (query_id)))
  WHERE rank <= 5
)"""

COMPARED = f"""{HEAD}, {HASHED}, {DENSE}, {TOP}, {B.ranked_sql("dots", 5, "d5")},
{B.ranked_sql("scored", 20, "s20")}, {B.ranked_sql("dots", 20, "d20")}, {fused_sql(["d5", "top"], 5, "h5")},
{fused_sql(["d20", "s20"], 20, "pool")}, {RERANKED},
{scores_sql({"dense": "d5", "sparse": "top", "hybrid": "h5", "rerank": "reranked"})},
lists AS (
  {" UNION ALL ".join(f"SELECT '{v}' AS variant, query_id, content_type, document_id, chunk_no, rank FROM {t}"
                      for v, t in {"dense": "d5", "sparse": "top", "hybrid": "h5", "rerank": "reranked"}.items())}
),
packed AS (
  SELECT variant, query_id, string_agg({PASSAGE}, chr(10) || chr(10) ORDER BY rank) AS context,
    max(CASE WHEN rank = 1 THEN trim(text, E' \\n\\t') END) AS best
  FROM lists JOIN fixed USING (content_type, document_id, chunk_no) GROUP BY ALL
),
answered AS (
  SELECT c.*, coalesce(context, '') AS context, {SENTENCE.format("best")} AS answer,
    CASE WHEN query_id % 2 = 0 THEN query END AS expected, n = 0 AND ({REFUSED.format(SENTENCE.format("best"))}) AS refused
  FROM case_scores c LEFT JOIN packed USING (variant, query_id)
),
final AS (
  SELECT *, CASE WHEN refused THEN 1 ELSE {overlap_sql("answer", "context")} END AS grounded,
    CASE WHEN expected IS NULL THEN {overlap_sql("answer", "context")} ELSE {overlap_sql("answer", "expected")} END AS relevance,
    len({B.words_sql("query")}) AS e,
    {len(A.SYSTEM_PROMPT.split())} + len({B.words_sql("'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || context")}) AS p,
    len({B.words_sql("answer")}) AS c
  FROM answered
)"""

def _collection(corpus: str, prefix: str) -> str:
    """Dense search over one corpus, ending in ``{prefix}top``."""
    sql = re.sub(r"\bfixed\b", corpus, f"{HASHED}, {DENSE}")
    sql = re.sub(r"\b(bucketed|hashed|qbuckets|qhashed|qnorm|pnorm|dots)\b", rf"{prefix}\1", sql)
    return f"{sql}, {B.ranked_sql(f'{prefix}dots', 5, f'{prefix}top')}"


ORACLE = {
    "eval_relevance": f"WITH {RELEVANT} SELECT query_id, document_id FROM relevant",
    "eval_retrieval": f"""{HEAD}, {TOP}, {scores_sql({"sparse": "top"})}
SELECT query_id, round(precision_at_k, 6) AS precision_at_k, round(reciprocal_rank, 6) AS reciprocal_rank,
  coalesce(round(recall_at_k, 6), -1) AS recall_at_k, coalesce(round(ndcg_at_k, 6), -1) AS ndcg_at_k FROM case_scores""",
    "eval_means": f"{HEAD}, {TOP}, {scores_sql({'sparse': 'top'})} SELECT {MEANS} FROM case_scores",
    "report_round_trip": f"""{COMPARED},
means AS (SELECT variant, {MEANS}, round(sum((e * 0.02::DOUBLE + p * 0.4::DOUBLE + c * 1.6::DOUBLE) / 1000000), 6) AS cost_usd_total FROM final GROUP BY variant)
SELECT variant, recall_at_k, mrr, ndcg_at_k, 0.0::DOUBLE AS ms, cost_usd_total FROM means""",
    "eval_by_category": f"""{COMPARED}
SELECT variant, CASE WHEN n = 0 THEN 'unanswerable' ELSE 'factual' END AS category, {MEANS} FROM final GROUP BY ALL""",
    "eval_chunkers": f"""WITH RECURSIVE {B.DOCS}, {B.LINES}, {B.QUESTIONS}, {B.FIXED}, {CHILDREN}, {STRUCTURED},
{_collection("fixed", "f_")}, {_collection("structured", "s_")}, {_collection("children", "c_")},
{scores_sql({"fixed_size": "f_top", "structure_aware": "s_top", "parent_child": "c_top"})}
SELECT variant, CASE WHEN n = 0 THEN 'unanswerable' ELSE 'factual' END AS category, {MEANS} FROM case_scores GROUP BY ALL""",
    "eval_failures": f"""{HEAD}, {TOP}, {scores_sql({"sparse": "top"})}
SELECT query_id, CASE WHEN len(query) % 3 = 0 THEN 'no model' ELSE '-' END AS error, round(precision_at_k, 6) AS precision_at_k,
  round(reciprocal_rank, 6) AS reciprocal_rank, CASE WHEN len(query) % 3 = 0 THEN 0 ELSE round(precision_at_k, 6) END AS context_precision,
  coalesce(round(recall_at_k, 6), -1) AS recall_at_k, coalesce(round(ndcg_at_k, 6), -1) AS ndcg_at_k,
  CASE WHEN len(query) % 3 = 0 THEN -1 ELSE coalesce(round(recall_at_k, 6), -1) END AS context_recall FROM case_scores""",
    "eval_compare": f"""{COMPARED}
SELECT variant, count(*) AS case_count, {MEANS}, round(avg(grounded), 6) AS faithfulness, round(avg(relevance), 6) AS answer_relevance,
  round(avg(precision_at_k), 6) AS context_precision, round(coalesce(avg(recall_at_k), 0), 6) AS context_recall, round(avg(grounded), 6) AS groundedness,
  0.0::DOUBLE AS end_to_end_ms, 0.0::DOUBLE AS retrieval_ms, 0.0::DOUBLE AS reranking_ms, 0.0::DOUBLE AS llm_ms,
  round(avg(e), 6) AS embed_tokens, round(avg(p), 6) AS llm_prompt_tokens, round(avg(c), 6) AS llm_completion_tokens,
  round(avg((e * 0.02::DOUBLE + p * 0.4::DOUBLE + c * 1.6::DOUBLE) / 1000000), 6) AS cost_usd, 0.0::DOUBLE AS error_rate,
  round(sum((e * 0.02::DOUBLE + p * 0.4::DOUBLE + c * 1.6::DOUBLE) / 1000000), 6) AS cost_usd_total
FROM final GROUP BY variant""",
    "eval_generation": f"""WITH pairs AS (
  SELECT * FROM (SELECT conv_id, turn, role, text AS answer, lag(text) OVER w AS context, lead(text) OVER w AS expected, lag(role) OVER w AS before
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'
),
graded AS (
  SELECT *, CASE WHEN conv_id % 3 = 0 AND ({REFUSED.format("answer")}) THEN 1
    WHEN trim(context, E' \\n\\t') = '' THEN 0 ELSE {overlap_sql("answer", "context")} END AS g FROM pairs
)
SELECT conv_id, turn, round(g, 6) AS faithfulness, round(g, 6) AS groundedness,
  round(CASE WHEN coalesce(expected, '') = '' THEN {overlap_sql("answer", "context")} ELSE {overlap_sql("answer", "expected")} END, 6) AS answer_relevance
FROM graded""",
    "case_selection": f"""WITH {RELEVANT}
SELECT item_id AS id, CASE WHEN n IS NULL THEN 'unanswerable' ELSE 'factual' END AS category
FROM (SELECT item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3) UNION ALL SELECT item_id FROM benchmark WHERE item_id = 7)
LEFT JOIN n_rel ON n_rel.query_id = item_id""",
    "refusals": f"""SELECT conv_id, turn, ({REFUSED.format("a")}) AS refused
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text || ' I Do Not Know.' ELSE text END AS a FROM conversations)""",
    "engineering_means": """WITH m AS (
  SELECT strftime(ts, '%H') AS variant, event_type = 'error' AS failed, value AS v, event_id % 50 AS e, event_id % 700 AS p, user_id AS c,
    ((event_id % 50) * 0.02::DOUBLE + (event_id % 700) * 0.4::DOUBLE + user_id * 1.6::DOUBLE) / 1000000 AS cost FROM events
)
SELECT variant, round(avg(v), 6) AS end_to_end_ms, round(avg(v / 2), 6) AS retrieval_ms, 0.0::DOUBLE AS reranking_ms, round(avg(v / 4), 6) AS llm_ms,
  round(avg(e), 6) AS embed_tokens, round(avg(p), 6) AS llm_prompt_tokens, round(avg(c), 6) AS llm_completion_tokens,
  round(avg(cost), 6) AS cost_usd, round(avg(failed::INT), 6) AS error_rate, round(sum(cost), 6) AS cost_usd_total
FROM m GROUP BY variant""",
    "case_costs": """SELECT event_id, round(((event_id % 50) * 0.02::DOUBLE + (event_id % 700) * 0.4::DOUBLE + user_id * 1.6::DOUBLE) / 1000000, 9) AS cost_usd FROM events""",
}

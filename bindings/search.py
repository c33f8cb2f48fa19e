"""Retrieval over chunks of ``documents`` and over ``embeddings``; questions from ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from bindings.chunks import CHILDREN, DIMS, HASHED, PARENTS, STRUCTURED
from gleaner.functions import text as T
from gleaner.operators import chunking as C
from gleaner.operators import dense as D
from gleaner.operators import embedding as E
from gleaner.operators import fusion as FU
from gleaner.operators import lexical as L
from gleaner.operators import parents as P
from gleaner.operators import ranking as R
from gleaner.operators import rerank as RR
from gleaner.session import cut_lineage


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "id", B.rounded("score").alias("score"))


def restricted_questions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("query_id")
    return B.questions(spark, sf).withColumns(
        {
            "filter_provider": F.when(n % 3 == 1, F.concat(F.lit("src"), (n % 20).cast("string"))).when(
                n % 3 == 2, F.lit("")
            ),
            "filter_content_type": F.when(n == 7, F.lit("review")).when(n % 5 == 0, F.lit("article")),
            "filter_section": F.when(n % 4 == 1, F.concat(F.lit("DOC "), (n % 10).cast("string")))
            .when(n % 4 == 2, F.lit("nowhere"))
            .when(n % 4 == 3, F.lit("doc")),
        }
    )


def sparse(spark: SparkSession, sf: str):
    return L.retriever(B.fixed_chunks(spark, sf))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return E.embed_chunks(B.fixed_chunks(spark, sf), E.hashing_embedder(DIMS))


def dense(spark: SparkSession, sf: str):
    return D.retriever(points(spark, sf), E.hashing_embedder(DIMS))


def hybrid(spark: SparkSession, sf: str):
    return FU.hybrid_retriever(*stored(spark, sf))


def stored(spark: SparkSession, sf: str):
    """Dense and sparse retrievers over one stored collection of chunks."""
    chunks = cut_lineage(B.fixed_chunks(spark, sf))
    embed = E.hashing_embedder(DIMS)
    return D.retriever(E.embed_chunks(chunks, embed), embed), L.retriever(chunks)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sparse(spark, sf)(B.questions(spark, sf)))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata filters before ranking, section hint with fallback after it."""
    return shown(sparse(spark, sf)(restricted_questions(spark, sf)))


def bm25_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    index = L.build_index(B.fixed_chunks(spark, sf), filterable=False)
    n = index.stats.select("n").scalar()
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.terms.select("term", "df", B.rounded(idf).alias("idf"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = B.table(spark, sf, "embeddings")
    asked = vectors.select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("filter_label"),
    )
    return vectors.withColumn("label", F.col("label").cast("string")), asked


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf)
    hits, _ = D.nearest(vectors, asked, R.TOP_K, ["vec_id"])
    return hits.select("query_id", "rank", "vec_id", B.rounded("score").alias("score"))


def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf)
    hits, _ = D.nearest(vectors, asked, R.TOP_K, ["vec_id"], filters={"label": "filter_label"})
    return hits.select("query_id", "rank", "vec_id", B.rounded("score").alias("score"))


def dense_text_topk(spark: SparkSession, sf: str) -> DataFrame:
    return shown(dense(spark, sf)(B.questions(spark, sf)))


def dense_text_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return shown(dense(spark, sf)(restricted_questions(spark, sf)))


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return shown(hybrid(spark, sf)(B.questions(spark, sf)))


def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Pool of 20 from the hybrid, reranked lexically, best 5."""
    return shown(RR.rerank_retriever(hybrid(spark, sf))(B.questions(spark, sf)))


def _token_count_scorer(query, text):
    """A stand-in for a pair model: distinct query tokens minus a length penalty."""
    hits = F.size(F.array_intersect(T.lexical_tokens(query), T.lexical_tokens(text)))
    return hits - F.size(T.lexical_tokens(text)) / F.lit(1000.0)


def pair_rerank(spark: SparkSession, sf: str) -> DataFrame:
    search = RR.rerank_retriever(sparse(spark, sf), RR.pair_rerank(_token_count_scorer))
    return shown(search(B.questions(spark, sf)))


def listwise_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers of every kind: good, partial, out of range, broken."""
    asked = B.questions(spark, sf)
    n = F.col("query_id") % 5
    responses = asked.select(
        "query_id",
        F.when(n == 0, F.lit('{"order": [3, 1, 0, 2]}'))
        .when(n == 1, F.lit("[19, 99, -1, 19, 4]"))
        .when(n == 2, F.lit('{"order": ["2", 1.9, "x"]}'))
        .when(n == 3, F.lit("no json"))
        .otherwise(F.lit('{"order": ["2", 1.9]}'))
        .alias("response"),
    )
    return shown(RR.listwise_rerank(sparse(spark, sf)(asked, 20), asked, responses))


def rerank_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompts = RR.rerank_prompts(sparse(spark, sf)(B.questions(spark, sf), 20))
    return prompts.select("query_id", F.md5("passages").alias("passages_md5"))


def parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.lined_documents(spark, sf)
    search = P.parent_expanding_retriever(L.retriever(C.child_chunks(docs)), C.parent_chunks(docs))
    return shown(search(B.questions(spark, sf)))


def variant_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked = B.lined_documents(spark, sf), B.questions(spark, sf)
    variants = FU.compare_variants(
        {
            "fixed_size": sparse(spark, sf)(asked),
            "parent_child": L.retriever(C.child_chunks(docs))(asked),
            "structure_aware": L.retriever(C.structure_aware_chunks(docs))(asked),
        }
    )
    return variants.select(
        "variant", "query_id", "rank", "id", "document_id", "title", "section",
        F.coalesce("parent_id", F.lit("-")).alias("parent_id"), B.rounded("score").alias("score"),
    )


def multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Questions split at line breaks: one ranking stays, several are fused."""
    lines = F.filter(F.split("query", "\n"), lambda x: F.trim(x) != "")
    subs = B.questions(spark, sf).select(
        "query_id", F.size(lines).alias("n_subs"), F.posexplode(lines).alias("sub_no", "query")
    )
    return shown(FU.multi_query_search(sparse(spark, sf), subs))


HEAD = f"WITH {B.DOCS}, {B.FIXED}, {B.QUESTIONS}"
SHOW = """SELECT query_id, rank, f.id, round(score, 6) AS score FROM {0} JOIN fixed f USING (content_type, document_id, chunk_no)"""

RESTRICTED = """
restricted AS (
  SELECT item_id AS query_id, text AS query,
    CASE WHEN item_id % 3 = 1 THEN 'src' || (item_id % 20) END AS fp,
    CASE WHEN item_id = 7 THEN 'review' WHEN item_id % 5 = 0 THEN 'article' END AS fc,
    CASE item_id % 4 WHEN 1 THEN 'doc ' || (item_id % 10) WHEN 2 THEN 'nowhere' WHEN 3 THEN 'doc' END AS hint
  FROM benchmark
)"""

DENSE = f"""
qbuckets AS (
  SELECT query_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIMS} AS bucket, count(*) AS c
  FROM (SELECT query_id, unnest({B.TOKENS.format("query")}) AS t FROM questions) GROUP BY ALL
),
qhashed AS (SELECT query_id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS FLOAT)::DOUBLE AS weight FROM qbuckets),
qnorm AS (SELECT query_id, sqrt(sum(weight * weight)) AS nrm FROM qhashed GROUP BY 1),
pnorm AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nrm FROM hashed GROUP BY 1),
dots AS (
  SELECT q.query_id, f.content_type, f.document_id, f.chunk_no,
         coalesce(d.s, 0) / (qn.nrm * pn.nrm) AS score
  FROM (SELECT query_id, id, sum(p.weight::DOUBLE * q.weight) AS s
        FROM hashed p JOIN qhashed q USING (bucket) GROUP BY ALL) d
  JOIN questions q USING (query_id) JOIN fixed f USING (id) JOIN qnorm qn USING (query_id) JOIN pnorm pn USING (id)
)"""


def fused_sql(lists: list[str], k: int, name: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT query_id, content_type, document_id, chunk_no, rank, {i} AS list_no FROM {r}"
        for i, r in enumerate(lists)
    )
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, list_no, r0) AS rank FROM (
      SELECT query_id, content_type, document_id, chunk_no, sum(1.0::DOUBLE / (60 + rank)) AS score,
             min(list_no) AS list_no, arg_min(rank, list_no * 1000 + rank) AS r0
      FROM ({union}) GROUP BY ALL)
  ) WHERE rank <= {k}
)"""


HYBRID20 = f"""{B.bm25_sql()}, {HASHED}, {DENSE},
{B.ranked_sql("scored", 20, "sparse20")}, {B.ranked_sql("dots", 20, "dense20")},
{fused_sql(["dense20", "sparse20"], 20, "pool")}"""

LEX = f"""len(list_intersect(list_distinct({B.TOKENS.format("q.query")}), list_distinct({B.TOKENS.format("f.text")})))
  / len(list_distinct({B.TOKENS.format("q.query")}))::DOUBLE"""


QUERIES = {
    "bm25_index_terms": bm25_index_terms,
    "bm25_topk": bm25_topk,
    "section_filter_fallback": bm25_filtered,
    "dense_topk": dense_topk,
    "dense_topk_filtered": dense_topk_filtered,
    "dense_text_topk": dense_text_topk,
    "dense_text_filtered": dense_text_filtered,
    "rrf_hybrid": rrf_hybrid,
    "lexical_rerank": lexical_rerank,
    "pair_rerank": pair_rerank,
    "listwise_rerank": listwise_rerank,
    "rerank_prompt": rerank_prompt,
    "parent_expand": parent_expand,
    "chunk_variant_compare": variant_compare,
    "multi_query_fusion": multi_query,
}


def _reranked(pool: str, score: str, k: int = 5) -> str:
    return f"""
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM (
    SELECT p.query_id, f.id, p.rank AS r0, {score} AS score
    FROM {pool} p JOIN fixed f USING (content_type, document_id, chunk_no) JOIN questions q USING (query_id)))
WHERE rank <= {k}"""


def _nearest(condition: str) -> str:
    return f"""
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
    FROM embeddings q JOIN embeddings c ON {condition}))
WHERE rank <= 5"""


LINE_HEAD = f"WITH {B.DOCS}, {B.LINES}, {CHILDREN}, {PARENTS}, {B.QUESTIONS}"

ORACLE = {
    "bm25_index_terms": f"""{HEAD}, {B.bm25_sql()}
SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, stats""",
    "bm25_topk": f"{HEAD}, {B.bm25_sql()}, {B.ranked_sql('scored', 5, 'top')} {SHOW.format('top')}",
    "section_filter_fallback": f"""{HEAD}, {RESTRICTED}, {B.bm25_sql(questions="restricted")},
flagged AS (
  SELECT s.*, hint IS NULL OR contains(lower(f.section), hint) AS m
  FROM scored s JOIN fixed f USING (content_type, document_id, chunk_no) JOIN restricted r USING (query_id)
  WHERE (fp IS NULL OR f.provider = fp) AND (fc IS NULL OR f.content_type = fc)
),
kept AS (SELECT * EXCLUDE (m, any_m) FROM (SELECT *, max(m) OVER (PARTITION BY query_id) AS any_m FROM flagged) WHERE m OR NOT any_m),
{B.ranked_sql("kept", 5, "top")} {SHOW.format("top")}""",
    "dense_topk": _nearest("true"),
    "dense_topk_filtered": _nearest("q.label = c.label"),
    "dense_text_topk": f"{HEAD}, {HASHED}, {DENSE}, {B.ranked_sql('dots', 5, 'top')} {SHOW.format('top')}",
    "dense_text_filtered": f"""{HEAD}, {RESTRICTED}, {HASHED}, {DENSE},
allowed AS (
  SELECT s.*, (hint IS NULL OR contains(lower(f.section), hint)) AS m, hint
  FROM dots s JOIN fixed f USING (content_type, document_id, chunk_no) JOIN restricted r USING (query_id)
  WHERE (fp IS NULL OR f.provider = fp) AND (fc IS NULL OR f.content_type = fc)
),
{B.ranked_sql("allowed", 15, "fetched")},
kept AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY query_id) AS any_m FROM fetched) WHERE m OR NOT any_m),
again AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kept)
{SHOW.format("again")} WHERE rank <= 5""",
    "rrf_hybrid": f"""{HEAD}, {B.bm25_sql()}, {HASHED}, {DENSE}, {B.ranked_sql("scored", 5, "s5")},
{B.ranked_sql("dots", 5, "d5")}, {fused_sql(["d5", "s5"], 5, "top")} {SHOW.format("top")}""",
    "lexical_rerank": f"{HEAD}, {HYBRID20} {_reranked('pool', LEX)}",
    "pair_rerank": f"""{HEAD}, {B.bm25_sql()}, {B.ranked_sql("scored", 20, "pool")} """
    + _reranked(
        "pool",
        f"len(list_intersect({B.TOKENS.format('q.query')}, {B.TOKENS.format('f.text')}))"
        f" - len({B.TOKENS.format('f.text')}) / 1000.0::DOUBLE",
    ),
    "listwise_rerank": f"""{HEAD}, {B.bm25_sql()}, {B.ranked_sql("scored", 20, "pool")},
sized AS (
  SELECT p.*, count(*) OVER (PARTITION BY query_id) AS n, f.id, {LEX} AS lex,
    CASE query_id % 5 WHEN 0 THEN [3, 1, 0, 2] WHEN 1 THEN [19, 4] WHEN 4 THEN [2, 1] END AS raw
  FROM pool p JOIN fixed f USING (content_type, document_id, chunk_no) JOIN questions q USING (query_id)
),
placed AS (SELECT *, list_filter(raw, lambda x: x < n) AS ord FROM sized),
ranks AS (
  SELECT query_id, id, n, lex, coalesce(len(ord), 0) > 0 AS good,
    row_number() OVER (PARTITION BY query_id ORDER BY
      CASE WHEN coalesce(len(ord), 0) = 0 THEN -lex END, list_position(ord, rank - 1) NULLS LAST, rank) AS rank
  FROM placed
)
SELECT query_id, rank, id, round(CASE WHEN good THEN n - rank + 1 ELSE lex END::DOUBLE, 6) AS score FROM ranks WHERE rank <= 5""",
    "rerank_prompt": f"""{HEAD}, {B.bm25_sql()}, {B.ranked_sql("scored", 20, "pool")}
SELECT query_id, md5(string_agg((rank - 1) || '. ' || title || ' / ' || section || ': ' || left(text, 1000), chr(10) ORDER BY rank)) AS passages_md5
FROM pool JOIN fixed f USING (content_type, document_id, chunk_no) GROUP BY query_id""",
    "parent_expand": f"""{LINE_HEAD}, {B.bm25_sql("children")}, {B.ranked_sql("scored", 5, "top")},
firsts AS (
  SELECT query_id, parent_id, min(rank) AS r0, arg_min(score, rank) AS score
  FROM top JOIN children c USING (content_type, document_id, chunk_no) GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank, p.id, round(score, 6) AS score
FROM firsts JOIN parents p ON p.id = firsts.parent_id""",
    "chunk_variant_compare": f"""{LINE_HEAD.replace("WITH", "WITH RECURSIVE", 1)}, {B.FIXED}, {STRUCTURED}, {B.bm25_sql()},
{B.bm25_sql("structured", prefix="s_").replace("FROM qt ", "FROM s_qt ")}, {B.ranked_sql("s_scored", 5, "s_top")}, {B.ranked_sql("scored", 5, "top")},
{B.bm25_sql("children", prefix="c_").replace("FROM qt ", "FROM c_qt ")}, {B.ranked_sql("c_scored", 5, "c_top")}
SELECT 'fixed_size' AS variant, query_id, rank, f.id, document_id, title, section, '-' AS parent_id, round(score, 6) AS score
FROM top JOIN fixed f USING (content_type, document_id, chunk_no)
UNION ALL
SELECT 'parent_child', query_id, rank, f.id, document_id, title, section, parent_id, round(score, 6)
FROM c_top JOIN children f USING (content_type, document_id, chunk_no)
UNION ALL
SELECT 'structure_aware', query_id, rank, f.id, document_id, title, section, '-', round(score, 6)
FROM s_top JOIN structured f USING (content_type, document_id, chunk_no)""",
    "multi_query_fusion": f"""{HEAD},
subs AS (
  SELECT query_id AS qid, query_id * 1000 + i AS query_id, i AS list_no, len(ls) AS n, ls[i] AS query
  FROM (SELECT query_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT query_id, list_filter(string_split(query, chr(10)), lambda x: trim(x) <> '') AS ls FROM questions))
),
{B.bm25_sql(questions="subs")}, {B.ranked_sql("scored", 5, "each_top")},
fused AS (
  SELECT qid, content_type, document_id, chunk_no, CASE WHEN any_value(n) = 1 THEN any_value(score)
           ELSE sum(1.0::DOUBLE / (60 + rank)) END AS score,
         sum(1.0::DOUBLE / (60 + rank)) AS fs, min(list_no * 1000 + rank) AS seen
  FROM each_top JOIN subs USING (query_id) GROUP BY ALL
),
top AS (
  SELECT qid AS query_id, content_type, document_id, chunk_no, score,
         row_number() OVER (PARTITION BY qid ORDER BY round(fs, 12) DESC, seen) AS rank FROM fused
) {SHOW.format("top")} WHERE rank <= 5""",
}

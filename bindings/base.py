"""Views of the given tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import chunking as C
from gleaner.session import fill_cores


# Tables whose rows are costly to process: worth all cores even from one file.
HEAVY = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return fill_cores(rows) if name in HEAVY else rows


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _documents(spark: SparkSession, sf: str, sections: Column) -> DataFrame:
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return (
        table(spark, sf, "documents")
        .withColumn("title", title)
        .select(
            F.col("doc_id").cast("string").alias("id"),
            "title",
            F.when(F.col("lang") == "en", "article").when(F.col("lang") == "fr", "review").otherwise("provider")
            .alias("content_type"),
            F.col("source").alias("provider"),
            F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
            null().alias("published_at"),
            F.col("lang").alias("updated_at"),
            sections.alias("sections"),
        )
    )


def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One section per document: the whole text under the title."""
    section = F.struct(
        F.col("title").alias("heading"), F.array("title").alias("heading_path"), F.col("text").alias("text")
    )
    return _documents(spark, sf, F.array(section))


def lined_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One section per line of text."""

    def section(line: Column, i: Column) -> Column:
        heading = F.concat(F.lit("part "), (i + 1).cast("string"))
        return F.struct(
            heading.alias("heading"),
            F.array(F.col("title"), heading).alias("heading_path"),
            line.alias("text"),
        )

    return _documents(spark, sf, F.transform(F.split("text", "\n"), section))


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.fixed_size_chunks(whole_documents(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


# --- the same in SQL ---------------------------------------------------------

DOCS = """
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'doc ' || doc_id AS title,
         CASE lang WHEN 'en' THEN 'article' WHEN 'fr' THEN 'review' ELSE 'provider' END AS content_type,
         source AS provider, 'http://docs.example/' || doc_id AS url, lang AS updated_at, text
  FROM documents
)"""

LINES = """
lines AS (
  SELECT d.*, u.i AS line_no, 'part ' || u.i AS heading, trim(u.parts[u.i], E' \\t\\r\\n') AS line
  FROM (SELECT docs.*, string_split(text, chr(10)) AS parts,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs) u
  JOIN docs d USING (doc_id)
  WHERE trim(u.parts[u.i], E' \\t\\r\\n') <> ''
)"""


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def two_digits(n: str) -> str:
    return f"(CASE WHEN {n} < 10 THEN '0' || CAST({n} AS VARCHAR) ELSE CAST({n} AS VARCHAR) END)"


FIXED = f"""
fixed_words AS (SELECT *, {words_sql("text")} AS words FROM docs),
fixed_at AS (
  SELECT *, unnest(range(0, CAST(1 + ceil(greatest(len(words) - 700, 0) / 620.0) AS BIGINT))) AS chunk_no
  FROM fixed_words WHERE len(words) > 0
),
fixed AS (
  SELECT content_type, id AS document_id, chunk_no, doc_id,
         content_type || '_' || id || '_fixed_' || {two_digits("(chunk_no + 1)")} AS id,
         provider, title, title AS section,
         array_to_string(words[chunk_no * 620 + 1 : chunk_no * 620 + 700], ' ') AS text, url, updated_at
  FROM fixed_at
)"""

QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9$]+')"


def bm25_sql(corpus: str = "fixed", questions: str = "questions", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}scored(query_id, content_type, document_id, chunk_no, score)``."""
    p = prefix
    body = "concat_ws(' ', nullif(title, ''), nullif(section, ''), nullif(provider, ''), nullif(text, ''))"
    return f"""
{p}toks AS (SELECT content_type, document_id, chunk_no, {TOKENS.format(body)} AS ts FROM {corpus}),
{p}stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {p}toks),
{p}tf AS (
  SELECT content_type, document_id, chunk_no, dl, term, count(*) AS tf
  FROM (SELECT content_type, document_id, chunk_no, len(ts) AS dl, unnest(ts) AS term FROM {p}toks)
  GROUP BY ALL
),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM {questions}) GROUP BY ALL
),
{p}scored AS (
  SELECT query_id, content_type, document_id, chunk_no,
         sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM {p}qt JOIN {p}df USING (term) JOIN {p}tf USING (term), {p}stats
  GROUP BY ALL
)"""


def ranked_sql(scored: str, k: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
             ORDER BY round(score, 9) DESC, content_type, document_id, chunk_no) AS rank FROM {scored})
  WHERE rank <= {k}
)"""



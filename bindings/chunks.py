"""Chunkers, embedding text, ids and embeddings over ``documents``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from gleaner.functions import text as T
from gleaner.operators import chunking as C
from gleaner.operators import embedding as E

DIMS = 64


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id",
        "document_id",
        "chunk_no",
        "section",
        F.array_join("heading_path", " > ").alias("path"),
        F.md5("text").alias("text_md5"),
        T.count_tokens(F.col("text")).alias("n_tokens"),
        F.coalesce("parent_id", F.lit("-")).alias("parent_id"),
    )


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(B.fixed_chunks(spark, sf))


def chunk_structure_aware(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.structure_aware_chunks(B.whole_documents(spark, sf)))


def chunk_structure_aware_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.structure_aware_chunks(B.lined_documents(spark, sf)))


def chunk_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.child_chunks(B.lined_documents(spark, sf)))


def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.parent_chunks(B.lined_documents(spark, sf)))


def chunk_variants(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.lined_documents(spark, sf)
    counted = [
        chunker(docs)
        .groupBy("document_id")
        .agg(F.count("*").alias("chunks"))
        .select(F.lit(name).alias("variant"), "document_id", "chunks")
        for name, chunker in C.CHUNKERS.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return B.fixed_chunks(spark, sf).select("id", F.md5(E.chunk_embedding_text()).alias("text_md5"))


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return B.fixed_chunks(spark, sf).select(
        "id", T.uuid5(F.concat(F.lit("chunk:"), F.col("id"))).alias("point_id")
    )


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    points = E.embed_chunks(B.fixed_chunks(spark, sf), E.hashing_embedder(DIMS))
    return points.select("id", F.posexplode("embedding").alias("bucket", "weight")).select(
        "id", "bucket", B.rounded(F.col("weight").cast("double")).alias("weight")
    )


def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id",
        T.count_tokens(text).alias("n_tokens"),
        F.size(T.lexical_tokens(text)).alias("n_lexical"),
        F.size(T.content_terms(text)).alias("n_terms"),
        T.slug(F.col("text")).alias("slug"),
        F.md5(T.collapse_spaces(text)).alias("collapsed_md5"),
    )


SHOWN = """id, document_id, chunk_no, section, path, md5(text) AS text_md5,
       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens, parent_id"""

SLUG = """coalesce(nullif(left(lower(trim(regexp_replace({0}, '[^a-zA-Z0-9]+', '_', 'g'), '_')), 40), ''), 'section')"""

# Packing as a recursion over the units of every text in ``sized(doc_id, text, ws)``.
PACKED = f"""
units AS (
  SELECT doc_id, list_transform(
    list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x, E' \\n\\t')), lambda x: x <> ''),
    lambda x: {{'u': x, 'n': len({B.words_sql("x")})}}) AS us
  FROM sized WHERE len(ws) > 700
),
fold AS (
  SELECT doc_id, us, 0::BIGINT AS i, []::VARCHAR[] AS done, []::STRUCT(u VARCHAR, n BIGINT)[] AS cur, 0::BIGINT AS tok
  FROM units
  UNION ALL
  SELECT doc_id, us, i + 1,
    CASE WHEN us[i + 1].n > 1000 THEN
      list_concat(CASE WHEN len(c2) > 0 THEN list_append(d2, array_to_string(list_transform(c2, lambda x: x.u), E'\\n\\n'))
                       ELSE d2 END,
        list_transform(range(0, CAST(1 + ceil(greatest(us[i + 1].n - 300, 0) / 220.0) AS BIGINT)),
          lambda j: array_to_string(list_filter(regexp_split_to_array(us[i + 1].u, '\\s+'), lambda x: x <> '')
                               [j * 220 + 1 : j * 220 + 300], ' ')))
      ELSE d2 END,
    CASE WHEN us[i + 1].n > 1000 THEN [] ELSE list_append(c2, us[i + 1]) END,
    CASE WHEN us[i + 1].n > 1000 THEN 0
         ELSE CAST(coalesce(list_sum(list_transform(c2, lambda x: x.n)), 0) AS BIGINT) + us[i + 1].n END
  FROM (
    SELECT *,
      CASE WHEN over THEN list_append(done, array_to_string(list_transform(cur, lambda x: x.u), E'\\n\\n')) ELSE done END AS d2,
      CASE WHEN over THEN cur[coalesce(list_min(list_filter(range(1, len(cur) + 1),
             lambda j: list_sum(list_transform(cur[j:], lambda x: x.n)) <= 80)), len(cur)):] ELSE cur END AS c2
    FROM (SELECT *, len(cur) > 0 AND tok + us[i + 1].n > 700 AS over FROM fold WHERE i < len(us))
  )
),
windows AS (
  SELECT doc_id, CASE WHEN len(cur) > 0
      THEN list_append(done, array_to_string(list_transform(cur, lambda x: x.u), E'\\n\\n')) ELSE done END AS parts
  FROM fold WHERE i = len(us)
  UNION ALL
  SELECT doc_id, [trim(text, E' \\n\\t')] FROM sized WHERE len(ws) BETWEEN 1 AND 700
),
parted AS (SELECT doc_id, parts, unnest(range(0, len(parts))) AS part_no FROM windows)"""

STRUCTURE = f"""
WITH RECURSIVE {B.DOCS},
sized AS (SELECT doc_id, text, {B.words_sql("text")} AS ws FROM docs),
{PACKED}
SELECT content_type || '_' || doc_id || '_doc_' || doc_id || '_' || {B.two_digits("(part_no + 1)")} AS id,
       CAST(doc_id AS VARCHAR) AS document_id, part_no AS chunk_no, 'doc ' || doc_id AS section, 'doc ' || doc_id AS path,
       md5(parts[part_no + 1]) AS text_md5, len({B.words_sql("parts[part_no + 1]")}) AS n_tokens, '-' AS parent_id
FROM parted JOIN docs USING (doc_id)"""

STRUCTURED = f"""
sized AS (SELECT doc_id * 1000000 + line_no AS doc_id, line AS text, {B.words_sql("line")} AS ws FROM lines),
{PACKED},
structured AS (
  SELECT content_type || '_' || l.doc_id || '_part_' || line_no || '_' || {B.two_digits("(part_no + 1)")} AS id,
         content_type, CAST(l.doc_id AS VARCHAR) AS document_id,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no, part_no) - 1 AS chunk_no, provider, title,
         heading AS section, title || ' > ' || heading AS path, parts[part_no + 1] AS text, '-' AS parent_id
  FROM parted p JOIN lines l ON p.doc_id = l.doc_id * 1000000 + l.line_no
)"""

CHILDREN = f"""
children_at AS (
  SELECT *, unnest(range(0, CAST(1 + ceil(greatest(len(ws) - 150, 0) / 110.0) AS BIGINT))) AS w
  FROM (SELECT *, {B.words_sql("line")} AS ws FROM lines)
),
children AS (
  SELECT content_type || '_' || id || '_part_' || line_no || '_child_' || {B.two_digits("(w + 1)")} AS id,
         content_type, id AS document_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no, w) - 1 AS chunk_no,
         provider, title, heading AS section, title || ' > ' || heading AS path,
         CASE WHEN len(ws) <= 150 THEN line ELSE array_to_string(ws[w * 110 + 1 : w * 110 + 150], ' ') END AS text,
         content_type || '_' || id || '_part_' || line_no || '_parent' AS parent_id, url
  FROM children_at
)"""

PARENTS = """
parents AS (
  SELECT content_type || '_' || id || '_part_' || line_no || '_parent' AS id, content_type, id AS document_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_no,
         provider, title, heading AS section, title || ' > ' || heading AS path, line AS text, '-' AS parent_id, url
  FROM lines
)"""


HASHED = f"""
bucketed AS (
  SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIMS} AS bucket, count(*) AS c
  FROM (SELECT id, unnest({B.TOKENS.format("'Title: ' || title || chr(10) || 'Provider: ' || provider || chr(10) || 'Section: ' || section || chr(10) || chr(10) || text")}) AS t FROM fixed)
  GROUP BY ALL
),
hashed AS (SELECT id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS weight FROM bucketed)"""

QUERIES = {
    "chunk_fixed": chunk_fixed,
    "chunk_structure_aware": chunk_structure_aware,
    "chunk_structure_aware_lines": chunk_structure_aware_lines,
    "chunk_parent_child": chunk_parent_child,
    "chunk_parents": chunk_parents,
    "chunk_variants": chunk_variants,
    "embedding_text": embedding_text,
    "point_ids": point_ids,
    "embed_hash": embed_hash,
    "text_tokens": text_tokens,
}

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

ORACLE = {
    "chunk_fixed": f"WITH {B.DOCS}, {B.FIXED} SELECT id, document_id, chunk_no, section, section AS path, "
    f"md5(text) AS text_md5, len({B.words_sql('text')}) AS n_tokens, '-' AS parent_id FROM fixed",
    "chunk_structure_aware": STRUCTURE,
    "chunk_structure_aware_lines": f"WITH RECURSIVE {B.DOCS}, {B.LINES}, {STRUCTURED} SELECT {SHOWN} FROM structured",
    "chunk_parent_child": f"WITH {B.DOCS}, {B.LINES}, {CHILDREN} SELECT {SHOWN} FROM children",
    "chunk_parents": f"WITH {B.DOCS}, {B.LINES}, {PARENTS} SELECT {SHOWN} FROM parents",
    "chunk_variants": f"""WITH RECURSIVE {B.DOCS}, {B.LINES}, {CHILDREN}, {B.FIXED}, {STRUCTURED}
SELECT 'parent_child' AS variant, document_id, count(*) AS chunks FROM children GROUP BY document_id
UNION ALL SELECT 'fixed_size', document_id, count(*) FROM fixed GROUP BY document_id
UNION ALL SELECT 'structure_aware', document_id, count(*) FROM structured GROUP BY document_id""",
    "embedding_text": f"WITH {B.DOCS}, {B.FIXED} SELECT id, md5('Title: ' || title || chr(10) || 'Provider: ' || provider "
    "|| chr(10) || 'Section: ' || section || chr(10) || chr(10) || text) AS text_md5 FROM fixed",
    "point_ids": f"""WITH {B.DOCS}, {B.FIXED},
digests AS (SELECT id, sha1(unhex('{T.URL_NAMESPACE}') || encode('chunk:' || id)) AS h FROM fixed)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' ||
  substr(h, 21, 12) AS point_id FROM digests""",
    "embed_hash": f"""WITH {B.DOCS}, {B.FIXED}, {HASHED}
SELECT id, bucket, round(coalesce(weight, 0)::DOUBLE, 6) AS weight
FROM (SELECT f.id, unnest(range(0, {DIMS})) AS bucket FROM fixed f) LEFT JOIN hashed USING (id, bucket)""",
    "text_tokens": f"""SELECT doc_id, len({B.words_sql("text")}) AS n_tokens,
  len({B.TOKENS.format("text")}) AS n_lexical,
  len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ({STOPS})))) AS n_terms,
  {SLUG.format("text")} AS slug, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_md5 FROM documents""",
}

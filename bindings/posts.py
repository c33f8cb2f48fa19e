"""Source shapes, relational export and collections over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from gleaner.operators import chunking as C
from gleaner.operators.embedding import embed_chunks, hashing_embedder
from gleaner.plans.ingest import ingest
from gleaner.schemas import CHUNK_KEY
from gleaner.session import new_folder
from gleaner.sources import collections as K
from gleaner.sources import export as X
from gleaner.sources import posts as P
from gleaner.sources import tables as TB
from gleaner.sources.records import write_json_arrays

DIMS = 16


def _records(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def guid(key: str):
        return F.concat(F.lit("http://site.example/?a=1&amp;id="), F.col(key).cast("string"))

    article = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        guid("p_partkey").alias("guid"),
        F.col("p_brand").alias("slug"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" by NEXTIVA or RingCentral")))
        .when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" by ringcentral")))
        .otherwise(F.col("p_name"))
        .alias("title"),
        F.when(F.col("p_size") > 5, F.col("p_type")).alias("content"),
        F.lit("2024-01-01").alias("post_date"),
        B.null().alias("post_modified"),
    )
    review = B.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lit("").alias("guid"),
        F.lower("c_name").alias("slug"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("content"),
        F.lit("2024-01-02").alias("post_date"),
        B.null().alias("post_modified"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("likes "), "c_mktsegment")).otherwise(F.lit("")).alias("review"),
        F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("provider"),
    )
    provider = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        guid("s_suppkey").alias("guid"),
        B.null().alias("slug"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("spare title")).alias("title"),
        F.lit("<p>page</p>").alias("content"),
        F.lit("2024-01-03").alias("post_date"),
        B.null().alias("post_modified"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(F.lit("")).alias("name"),
    )
    return {"article": article, "review": review, "provider": provider}


def shape_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.union_posts(_records(spark, sf))
    return rows.select(
        "content_type", "id", "title", "slug", "html", F.coalesce("provider", F.lit("-")).alias("provider"),
        F.coalesce("url", F.lit("-")).alias("url"), "published_at",
    )


def records_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written as lines and as arrays, both read back as posts."""
    folder = new_folder(spark, "records")
    rows = _records(spark, sf)["article"].withColumn("id", F.col("id").cast("string"))
    rows.write.json(f"{folder}/lines")
    write_json_arrays(rows, f"{folder}/arrays", "id")
    both = [
        P.as_posts(P.read_records(spark, f"{folder}/{form}", "article", lines=form == "lines"), "article")
        .select(F.lit(form).alias("form"), "id", "title", "html", F.coalesce("provider", F.lit("-")).alias("provider"))
        for form in ("lines", "arrays")
    ]
    return both[0].unionByName(both[1])


def first_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that several types share: the article comes first, and a type can be asked for."""
    posts = P.union_posts(_records(spark, sf))
    any_type, provider = P.get_post(posts, 7), P.get_post(posts, 7, "provider")
    return any_type.unionByName(provider).select("content_type", "id", "title")


def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks written as tables and read back."""
    folder = new_folder(spark, "tables")
    docs = B.whole_documents(spark, sf)
    TB.write_documents(docs, f"{folder}/documents")
    TB.write_chunks(C.fixed_size_chunks(TB.read_documents(spark, f"{folder}/documents")), folder, "fixed_size")
    chunks = TB.read_chunks(spark, folder, "fixed_size")
    names = TB.read_documents(spark, f"{folder}/documents").select(F.col("id").alias("document_id"), "name")
    return chunks.join(names, "document_id").select("name", "id", "document_id", F.md5("text").alias("text_md5"))


def case_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation cases written as arrays and read back, with their categories."""
    folder = new_folder(spark, "cases")
    rows = B.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.array(F.col("item_id").cast("string")).alias("expected_documents"),
        F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("expected_answer"),
        F.when(F.col("item_id") % 3 == 0, "factual").otherwise("pricing").alias("category"),
    )
    write_json_arrays(rows, folder, "id", per_file=7)
    back = TB.read_cases(spark, folder)
    return back.select("id", "question", F.coalesce("expected_answer", F.lit("-")).alias("expected_answer"), "category")


def eav_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of three event types per user."""
    events = B.table(spark, sf, "events").select(
        "user_id", "event_type", F.col("value"), F.struct("ts", "event_id").alias("at")
    )
    keys = ("click", "view", "error")
    return X.eav_pivot(events, keys, "user_id", "event_type", "value", "at")


def _site(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as posts, their lines as attributes."""
    priority = F.substring("o_orderpriority", 1, 1)
    posts = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.when(priority == "1", "provider")
        .when(priority == "2", "user-reviews")
        .when(priority == "3", "blog_post")
        .when(priority == "4", "news_post")
        .otherwise("page")
        .alias("post_type"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("publish").alias("post_status"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("post_title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("post_date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), F.col("o_custkey").cast("int") % 30), "yyyy-MM-dd").alias("post_modified"),
        F.lit("g").alias("guid"),
        F.lit("n").alias("post_name"),
        F.col("o_orderstatus").alias("post_content"),
        B.null().alias("post_excerpt"),
    )
    line = F.col("l_linenumber")
    meta = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.when(line == 1, "provider").when(line == 2, "pros").when(line == 3, "rating_price").when(line == 4, "meta_description")
        .when(line == 5, "review").otherwise("unused").alias("meta_key"),
        F.when((line == 1) & (F.col("l_returnflag") == "A"), F.lit("n/a"))
        .when(line == 1, F.col("l_partkey").cast("string"))
        .otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string")))
        .alias("meta_value"),
        F.struct("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey").alias("meta_id"),
    )
    return posts, meta


def latest_n_export(spark: SparkSession, sf: str) -> DataFrame:
    posts, _ = _site(spark, sf)
    return X.export_articles(posts, 1000).select("id", "title", "content", "excerpt", "post_date", "post_type")


def export_providers(spark: SparkSession, sf: str) -> DataFrame:
    return X.export_providers(*_site(spark, sf), 300).select("id", "name", "post_modified", "meta_description")


def export_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.export_reviews(*_site(spark, sf), 3000)
    return rows.select(
        "id", "title", "post_date", "pros", "cons", "review", "rating_price", "provider",
        F.coalesce("provider_id", F.lit(-1)).alias("provider_id"),
    )


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Articles and provider pages exist; two versions of articles, and reviews, come in."""
    points = K.as_points(B.fixed_chunks(spark, sf))
    version = F.lit(0).alias("version")
    existing = points.filter("content_type IN ('article', 'provider')").select("*", version)
    first = points.filter("content_type = 'article'").withColumns(
        {"text": F.concat("text", F.lit(" v1")), "version": F.lit(1)}
    )
    second = points.filter("content_type IN ('article', 'review')").withColumns(
        {"text": F.concat("text", F.lit(" v2")), "version": F.lit(2)}
    )
    latest = K.latest_per_point(first.unionByName(second), ["version", *CHUNK_KEY]).drop("copies")
    merged = K.merge(existing, latest.select(*existing.columns))
    return merged.select("point_id", "chunk_id", "version", F.md5("text").alias("text_md5"))


def collection_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks upserted twice, the second time with new texts of articles, copied
    to another collection and read back."""
    folder = new_folder(spark, "collections")
    chunks = B.fixed_chunks(spark, sf)
    again = chunks.filter("content_type = 'article'").withColumn("text", F.concat("text", F.lit(" v2")))
    K.ensure_collection(spark, f"{folder}/a/fixed", DIMS)
    for batch in (chunks, again):
        K.upsert(K.as_points(embed_chunks(batch, hashing_embedder(DIMS))), f"{folder}/a/fixed", CHUNK_KEY)
    K.copy_collections(spark, ["fixed", "missing"], f"{folder}/a", f"{folder}/b", ["chunk_id"])
    back = K.as_chunks(K.read_points(spark, f"{folder}/b/fixed"))
    return back.select("id", "document_id", F.size("embedding").alias("dims"), F.array_join("heading_path", "|").alias("path"),
                       F.md5("text").alias("text_md5"))


def ingest_job(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of all shapes through normalization, chunking, embedding and upsert."""
    folder = new_folder(spark, "ingest")
    ingest(P.union_posts(_records(spark, sf)), folder, hashing_embedder(DIMS), DIMS, ("fixed_size",))
    points = K.read_points(spark, f"{folder}/collections/fixed_size")
    return points.groupBy("content_type").agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents")
    )


def ingest_chunkers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job with every chunker: documents, chunks, parents and points are
    read back from their folders. The counts of the job's own reports come along."""
    folder = new_folder(spark, "ingest")
    reports = ingest(P.union_posts(_records(spark, sf)), folder, hashing_embedder(DIMS), DIMS)
    documents = TB.read_documents(spark, f"{folder}/documents").select("content_type", F.col("id").alias("document_id"))
    parts = []
    for name, report in reports.items():
        points = K.as_chunks(K.read_points(spark, f"{folder}/collections/{name}"))
        stages = {"chunks": TB.read_chunks(spark, folder, name), "points": points}
        if name == "parent_child":
            stages["parents"] = TB.read_chunks(spark, folder, name, parents=True)
        for stage, rows in stages.items():
            counts = rows.join(documents, ["content_type", "document_id"]).groupBy("content_type").agg(
                F.count("*").alias("n_rows"), F.countDistinct("document_id").alias("n_documents"),
                F.sum(F.length("text")).alias("n_characters"),
            )
            parts.append(counts.select(F.lit(name).alias("chunker"), F.lit(stage).alias("stage"), "*"))
        told = report.filter("document_id IS NOT NULL").groupBy("content_type").agg(
            F.sum("chunks").alias("n_rows"), F.count("*").alias("n_documents"), F.lit(0).cast("long").alias("n_characters")
        )
        parts.append(told.select(F.lit(name).alias("chunker"), F.lit("report").alias("stage"), "*"))
    return reduce(DataFrame.unionByName, parts)


def index_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.index_report(B.fixed_chunks(spark, sf))
    return rows.select(
        F.coalesce("content_type", F.lit("all")).alias("content_type"),
        F.coalesce("document_id", F.lit("all")).alias("document_id"),
        "chunks",
    )


QUERIES = {
    "shape_union": shape_union,
    "records_round_trip": records_round_trip,
    "first_posts": first_posts,
    "document_round_trip": document_round_trip,
    "case_round_trip": case_round_trip,
    "eav_pivot": eav_pivot,
    "latest_n_export": latest_n_export,
    "export_providers": export_providers,
    "export_reviews": export_reviews,
    "upsert": upsert,
    "collection_copy": collection_copy,
    "ingest_job": ingest_job,
    "ingest_chunkers": ingest_chunkers,
    "index_report": index_report,
}

SITE = """
posts AS (
  SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'provider' WHEN '2' THEN 'user-reviews' WHEN '3' THEN 'blog_post'
      WHEN '4' THEN 'news_post' ELSE 'page' END AS post_type, o_orderstatus <> 'P' AS published, 'order ' || o_orderkey AS title,
    strftime(o_orderdate, '%Y-%m-%d') AS post_date, strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INTEGER), '%Y-%m-%d') AS post_modified,
    o_orderstatus AS content FROM orders
),
meta AS (
  SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'provider' WHEN 2 THEN 'pros' WHEN 3 THEN 'rating_price' WHEN 4 THEN 'meta_description'
      WHEN 5 THEN 'review' ELSE 'unused' END AS k,
    CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 'n/a' WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) ELSE l_returnflag || l_partkey END AS v,
    row(l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS o FROM lineitem
),
attrs AS (
  SELECT id, arg_max(v, o) FILTER (k = 'provider') AS provider, arg_max(v, o) FILTER (k = 'pros') AS pros, arg_max(v, o) FILTER (k = 'rating_price') AS rating_price,
    arg_max(v, o) FILTER (k = 'meta_description') AS meta_description, arg_max(v, o) FILTER (k = 'review') AS review FROM meta GROUP BY 1
)"""

ORACLE = {
    "shape_union": """SELECT 'article' AS content_type, CAST(p_partkey AS VARCHAR) AS id,
  CASE p_size % 3 WHEN 0 THEN p_name || ' by NEXTIVA or RingCentral' WHEN 1 THEN p_name || ' by ringcentral' ELSE p_name END AS title,
  p_brand AS slug, CASE WHEN p_size > 5 THEN p_type ELSE '' END AS html,
  CASE p_size % 3 WHEN 0 THEN 'Nextiva' WHEN 1 THEN 'RingCentral' ELSE '-' END AS provider,
  'http://site.example/?a=1&id=' || p_partkey AS url, '2024-01-01' AS published_at FROM part
UNION ALL
SELECT 'review', CAST(c_custkey AS VARCHAR), c_name, lower(c_name), CASE WHEN c_acctbal > 0 THEN 'likes ' || c_mktsegment ELSE c_mktsegment END,
  CASE WHEN c_nationkey > 5 THEN c_mktsegment ELSE '-' END, '-', '2024-01-02' FROM customer
UNION ALL
SELECT 'provider', CAST(s_suppkey AS VARCHAR), n, '', '<p>page</p>', coalesce(nullif(n, ''), '-'), 'http://site.example/?a=1&id=' || s_suppkey, '2024-01-03'
FROM (SELECT *, CASE WHEN s_acctbal > 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN 'spare title' ELSE '' END AS n FROM supplier)""",
    "records_round_trip": """SELECT form, CAST(p_partkey AS VARCHAR) AS id,
  CASE p_size % 3 WHEN 0 THEN p_name || ' by NEXTIVA or RingCentral' WHEN 1 THEN p_name || ' by ringcentral' ELSE p_name END AS title,
  CASE WHEN p_size > 5 THEN p_type ELSE '' END AS html,
  CASE p_size % 3 WHEN 0 THEN 'Nextiva' WHEN 1 THEN 'RingCentral' ELSE '-' END AS provider
FROM part, (VALUES ('lines'), ('arrays')) f(form)""",
    "first_posts": """SELECT 'article' AS content_type, '7' AS id,
  CASE p_size % 3 WHEN 0 THEN p_name || ' by NEXTIVA or RingCentral' WHEN 1 THEN p_name || ' by ringcentral' ELSE p_name END AS title
FROM part WHERE p_partkey = 7
UNION ALL SELECT 'provider', '7', CASE WHEN s_acctbal > 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN 'spare title' ELSE '' END
FROM supplier WHERE s_suppkey = 7""",
    "document_round_trip": f"""WITH {B.DOCS}, {B.FIXED}
SELECT content_type || '-' || document_id || '-doc-' || document_id AS name, id, document_id, md5(text) AS text_md5 FROM fixed""",
    "case_round_trip": """SELECT CAST(item_id AS VARCHAR) AS id, text AS question,
  CASE WHEN item_id % 2 = 0 THEN text ELSE '-' END AS expected_answer, CASE WHEN item_id % 3 = 0 THEN 'factual' ELSE 'pricing' END AS category
FROM benchmark""",
    "eav_pivot": """SELECT user_id, arg_max(value, row(ts, event_id)) FILTER (event_type = 'click') AS click,
  arg_max(value, row(ts, event_id)) FILTER (event_type = 'view') AS view, arg_max(value, row(ts, event_id)) FILTER (event_type = 'error') AS error
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1""",
    "latest_n_export": f"""WITH {SITE} SELECT id, title, content, '' AS excerpt, post_date, post_type FROM posts
WHERE post_type IN ('blog_post', 'news_post', 'library_post') AND published ORDER BY post_date DESC, id DESC LIMIT 1000""",
    "export_providers": f"""WITH {SITE}, newest AS (SELECT * FROM posts WHERE post_type = 'provider' AND published
  ORDER BY post_modified DESC, post_date DESC, id DESC LIMIT 300)
SELECT id, title AS name, post_modified, coalesce(meta_description, '') AS meta_description FROM newest LEFT JOIN attrs USING (id)""",
    "export_reviews": f"""WITH {SITE}, newest AS (SELECT * FROM posts WHERE post_type = 'user-reviews' AND published ORDER BY post_date DESC, id DESC LIMIT 3000),
numbered AS (SELECT n.*, a.* EXCLUDE (id), CASE WHEN regexp_full_match(provider, '[0-9]+') THEN CAST(provider AS BIGINT) END AS pid FROM newest n LEFT JOIN attrs a USING (id))
SELECT r.id, r.title, r.post_date, coalesce(pros, '') AS pros, '' AS cons, coalesce(review, '') AS review, coalesce(rating_price, '') AS rating_price,
  coalesce(p.title, '') AS provider, coalesce(pid, -1) AS provider_id
FROM (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(coalesce(provider, ''), '[0-9]+') THEN provider END AS BIGINT) AS pid2 FROM numbered) r LEFT JOIN posts p ON p.id = r.pid2""",
    "upsert": f"""WITH {B.DOCS}, {B.FIXED},
rows AS (
  SELECT id, 0 AS version, text FROM fixed WHERE content_type = 'provider'
  UNION ALL SELECT id, 2, text || ' v2' FROM fixed WHERE content_type IN ('article', 'review')
),
digests AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || id)) AS h FROM rows)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
  id AS chunk_id, version, md5(text) AS text_md5 FROM digests""",
    "collection_copy": f"""WITH {B.DOCS}, {B.FIXED}
SELECT id, document_id, {DIMS} AS dims, title AS path, md5(text || CASE WHEN content_type = 'article' THEN ' v2' ELSE '' END) AS text_md5 FROM fixed""",
    "ingest_job": """SELECT 'article' AS content_type, count(*) AS chunks, count(*) AS documents FROM part WHERE p_size > 5
UNION ALL SELECT 'review', count(*), count(*) FROM customer UNION ALL SELECT 'provider', count(*), count(*) FROM supplier""",
    "ingest_chunkers": """WITH texts AS (
  SELECT 'article' AS content_type, p_type AS t FROM part WHERE p_size > 5
  UNION ALL SELECT 'review', CASE WHEN c_acctbal > 0 THEN 'likes ' || c_mktsegment ELSE c_mktsegment END FROM customer
  UNION ALL SELECT 'provider', 'page' FROM supplier
),
counts AS (SELECT content_type, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS c FROM texts GROUP BY 1)
SELECT chunker, stage, content_type, n AS n_rows, n AS n_documents, CASE WHEN stage = 'report' THEN 0 ELSE c END AS n_characters
FROM counts, (VALUES ('structure_aware'), ('fixed_size'), ('parent_child')) v(chunker),
  (VALUES ('chunks'), ('points'), ('report'), ('parents')) s(stage)
WHERE stage <> 'parents' OR chunker = 'parent_child'""",
    "index_report": f"""WITH {B.DOCS}, {B.FIXED}
SELECT content_type, document_id, count(*) AS chunks FROM fixed GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM fixed""",
}

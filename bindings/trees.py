"""Clustering over ``embeddings`` and summary trees over chunks of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from bindings import kmeans_sql as KQ
from bindings.chunks import CHILDREN
from bindings.search import shown
from gleaner.functions import vectors as V
from gleaner.operators import chunking as C
from gleaner.operators import embedding as E
from gleaner.operators import kmeans as KM
from gleaner.operators import tree as TR
from gleaner.plans import trees as PT
from gleaner.session import cut_lineage, new_folder
from gleaner.sources import tables

DIMS = 64
# The documents that change in tree_incremental.
CHANGED = "CAST(document_id AS BIGINT) % 333 = 7"


def kmeans_update(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the labels."""
    vectors = B.table(spark, sf, "embeddings").withColumn("cluster", F.col("label"))
    return KM.update(vectors).select("cluster", F.posexplode("center").alias("pos", "v")).select(
        "cluster", "pos", B.rounded("v").alias("v")
    )


def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector to the most similar label centroid: one round of k-means."""
    vectors = B.table(spark, sf, "embeddings")
    centers = cut_lineage(KM.update(vectors.withColumn("cluster", F.col("label"))))
    rows = KM.assign(vectors, centers)
    return rows.select("vec_id", "cluster", B.rounded("similarity").alias("similarity"))


def vector_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector and the next one."""
    left = B.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return left.join(right, "vec_id").select("vec_id", B.rounded(V.cosine(F.col("a"), F.col("b"))).alias("cosine"))


def kmeans_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return KM.spherical_kmeans(B.table(spark, sf, "embeddings"), 10, "vec_id").select("vec_id", "cluster")


def cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return counted.select("conv_id", "n", TR.cluster_count_column(F.col("n")).alias("k"))


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return TR.leaves_from_chunks(C.child_chunks(B.lined_documents(spark, sf)))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours four by four instead of clustering, so that SQL can follow."""
    return leaves(spark, sf).withColumn("cluster", F.floor(F.col("ord") / 4).cast("int"))


def tree_level(spark: SparkSession, sf: str) -> DataFrame:
    parents, _ = TR.build_level(_assigned(spark, sf), 1)
    return parents.select(
        "id", "level", "node_type", "document_id", "provider", "title", "section", "source_url", "ord",
        F.md5("text").alias("text_md5"), F.array_join("heading_path", " > ").alias("path"),
        F.array_join("children", "|").alias("children"),
    )


def tree_children(spark: SparkSession, sf: str) -> DataFrame:
    _, children = TR.build_level(_assigned(spark, sf), 1)
    return children.select("document_id", "ord", "id", "parent_id")


def tree_prompt(spark: SparkSession, sf: str) -> DataFrame:
    parents, _ = TR.build_level(_assigned(spark, sf), 1, summarize=lambda prompt: prompt)
    return parents.select("id", F.md5("text").alias("prompt_md5"))


def tree_node_text(spark: SparkSession, sf: str) -> DataFrame:
    parents, _ = TR.build_level(_assigned(spark, sf), 1)
    return parents.select("id", F.md5(TR.node_embedding_text()).alias("text_md5"))


def tree_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: all leaves and every other parent as hits."""
    parents, children = TR.build_level(_assigned(spark, sf), 1)
    columns = [F.col("document_id").alias("query_id"), "id", "node_type", "children"]
    hits = children.select(*columns).unionByName(parents.filter(F.col("ord") % 2 == 0).select(*columns))
    return TR.collapse(hits).select("query_id", "id", "node_type")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return TR.build_tree(leaves(spark, sf), E.hashing_embedder(DIMS))


def listed(nodes: DataFrame) -> DataFrame:
    """Nodes with their place in the tree and a digest of their text."""
    return nodes.select(
        "document_id", "level", "id", "parent_id", F.array_join("children", "|").alias("children"), F.md5("text").alias("text_md5")
    )


def tree_build(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of every document's tree."""
    return listed(tree(spark, sf))


def tree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = TR.tree_report(tree(spark, sf))
    return rows.select("document_id", "nodes", "leaves", "summaries")


def tree_search(spark: SparkSession, sf: str) -> DataFrame:
    """All questions over stored trees; trees whose caps rule them out are not scanned."""
    embed, root = E.hashing_embedder(DIMS), new_folder(spark, "trees")
    PT.update_trees(leaves(spark, sf), root, embed)
    return shown(PT.stored_retriever(spark, root, embed)(B.questions(spark, sf)))


def tree_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Stored trees after some documents changed (``CHANGED``): the run that wrote each tree, and its nodes."""
    embed, root = E.hashing_embedder(DIMS), new_folder(spark, "trees")
    before = leaves(spark, sf)
    PT.update_trees(before, root, embed)
    changed = F.when(F.expr(CHANGED), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    current = PT.update_trees(before.withColumn("text", changed), root, embed)
    # By id, not by the written node: "_10=" would come after "_100=".
    node = F.struct("id", F.md5("text").alias("text_md5"))
    told = F.transform(F.array_sort(F.collect_list(node)), lambda n: F.concat(n["id"], F.lit("="), n["text_md5"]))
    digests = PT.stored_nodes(spark, root).groupBy("document_id").agg(
        F.count("*").alias("nodes"), F.md5(F.array_join(told, ",")).alias("nodes_md5")
    )
    return current.select("document_id", "run").join(digests, "document_id")


def tree_accessors(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves, roots, and the children of roots, of trees of one level."""
    parents, children = TR.build_level(_assigned(spark, sf), 1)
    nodes = cut_lineage(parents.unionByName(children.select(*parents.columns)))
    place = [F.lit(None).cast("string").alias("of"), F.lit(None).cast("int").alias("child_no")]
    below = TR.children_of(nodes, TR.roots_of(nodes)).select(F.lit("child").alias("part"), "id", "of", "child_no")
    return (
        TR.leaves_of(nodes).select(F.lit("leaf").alias("part"), "id", *place)
        .unionByName(TR.roots_of(nodes).select(F.lit("root").alias("part"), "id", *place))
        .unionByName(below)
    )


def tree_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of one level through the tree table and their payload, and back."""
    parents, children = TR.build_level(_assigned(spark, sf), 1)
    folder = new_folder(spark, "tree-table")
    tables.write_tree(parents.unionByName(children.select(*parents.columns)), folder)
    stored = TR.as_node_payload(tables.read_tree(spark, folder))
    back = TR.from_node_payload(stored)
    return back.select(
        "id", "level", "node_type", "section", F.array_join("heading_path", " > ").alias("path"), "provider", "source_url",
        F.coalesce("parent_id", F.lit("-")).alias("parent_id"), F.size("children").alias("n_children"), F.md5("text").alias("text_md5"),
    )


QUERIES = {
    "vector_cosine": vector_cosine,
    "kmeans_update": kmeans_update,
    "kmeans_assign": kmeans_assign,
    "kmeans_corpus": kmeans_corpus,
    "cluster_counts": cluster_counts,
    "tree_level": tree_level,
    "tree_children": tree_children,
    "tree_prompt": tree_prompt,
    "tree_node_text": tree_node_text,
    "tree_collapse": tree_collapse,
    "tree_build": tree_build,
    "tree_sizes": tree_sizes,
    "tree_search": tree_search,
    "tree_incremental": tree_incremental,
    "tree_accessors": tree_accessors,
    "tree_payload": tree_payload,
}

CENTERS = """
entries AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
lengths AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM entries GROUP BY 1),
units AS (SELECT vec_id, label, pos, x / l AS x FROM entries JOIN lengths USING (vec_id)),
means AS (SELECT label, pos, avg(x) AS m FROM units GROUP BY ALL),
centers AS (SELECT label AS cluster, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM means)"""

GROUPED = f"""
WITH {B.DOCS}, {B.LINES}, {CHILDREN},
groups AS (SELECT *, CAST(floor(chunk_no / 4) AS BIGINT) AS g FROM children),
parented AS (SELECT *, 'raptor_' || document_id || '_l1_' || {B.two_digits("g")} AS parent FROM groups)"""
SUMMARY = "string_agg(section || ': ' || trim(text, E' \\n\\t'), ' ' ORDER BY chunk_no)"

LEAVES = "leaves AS (SELECT document_id, chunk_no AS ord, id, section, title, provider, text, content_type FROM children)"
TREE = f"WITH RECURSIVE {B.DOCS}, {B.LINES}, {CHILDREN}, {LEAVES}, {KQ.tree('t', 'leaves', DIMS)}"

ORACLE = {
    "kmeans_corpus": f"""WITH RECURSIVE corpus AS (SELECT 0 AS g, vec_id AS key, CAST(vec_id AS VARCHAR) AS name, embedding AS vector FROM embeddings),
{KQ.clusters("c", "corpus", "10")} SELECT key AS vec_id, cluster FROM c_clusters""",
    "tree_build": f"""{TREE} SELECT document_id, level, id, parent_id, array_to_string(children, '|') AS children, md5(text) AS text_md5 FROM t_nodes""",
    "tree_incremental": f"""WITH RECURSIVE {B.DOCS}, {B.LINES}, {CHILDREN}, {LEAVES},
altered AS (SELECT document_id, ord, id, section, title, provider, CASE WHEN {CHANGED} THEN text || ' changed' ELSE text END AS text, content_type FROM leaves),
{KQ.tree("t", "altered", DIMS)}
SELECT document_id, CASE WHEN {CHANGED} THEN 1 ELSE 0 END AS run, count(*) AS nodes, md5(string_agg(id || '=' || md5(text), ',' ORDER BY id)) AS nodes_md5
FROM t_nodes GROUP BY document_id""",
    "tree_search": f"""{TREE},
questions AS (SELECT item_id AS id, text FROM benchmark), {KQ.embedded("q", "questions", "text", DIMS)},
scored AS (
  SELECT q.id AS query_id, n.id, n.parent_id, n.content_type, n.document_id,
         coalesce(list_cosine_similarity(CAST(n.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 0) AS score FROM q, t_nodes n
),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, content_type, document_id, id) AS r FROM scored QUALIFY r <= 15),
kept AS (SELECT * FROM hits h ANTI JOIN hits p ON p.query_id = h.query_id AND p.id = h.parent_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, id, round(score, 6) AS score FROM kept QUALIFY rank <= 5""",
    "tree_accessors": f"""{GROUPED}
SELECT 'leaf' AS part, id, NULL AS of, NULL AS child_no FROM parented UNION ALL SELECT DISTINCT 'root', parent, NULL, NULL FROM parented
UNION ALL SELECT 'child', id, parent, row_number() OVER (PARTITION BY parent ORDER BY chunk_no) - 1 FROM parented""",
    "tree_payload": f"""{GROUPED}
SELECT id, 0 AS level, 'leaf' AS node_type, section, path, provider, url AS source_url, parent AS parent_id, 0 AS n_children, md5(text) AS text_md5 FROM parented
UNION ALL SELECT parent, 1, 'summary', 'Summary', any_value(title) || ' > Summary', any_value(provider), any_value(url), '-', count(*), md5({SUMMARY}) FROM parented GROUP BY parent""",
    "tree_sizes": f"""{TREE} SELECT document_id, count(*) AS nodes, CAST(count_if(level = 0) AS BIGINT) AS leaves, CAST(count_if(level > 0) AS BIGINT) AS summaries FROM t_nodes GROUP BY 1""",
    "vector_cosine": """SELECT l.vec_id, round(list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1""",
    "kmeans_update": f"WITH {CENTERS} SELECT cluster, pos, round(v, 6) AS v FROM centers",
    "kmeans_assign": f"""WITH {CENTERS},
sims AS (SELECT vec_id, cluster, sum(x * v) AS s FROM units JOIN centers USING (pos) GROUP BY ALL)
SELECT vec_id, cluster, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, cluster) AS r FROM sims) WHERE r = 1""",
    "cluster_counts": """SELECT conv_id, count(*) AS n, CASE WHEN count(*) <= 1 THEN count(*)
  ELSE greatest(2, least(count(*), CAST(ceil(count(*) / 4.0) AS BIGINT))) END AS k FROM conversations GROUP BY 1""",
    "tree_level": f"""{GROUPED}
SELECT parent AS id, 1 AS level, 'summary' AS node_type, document_id, any_value(provider) AS provider, any_value(title) AS title, 'Summary' AS section,
  any_value(url) AS source_url, any_value(g) AS ord, md5({SUMMARY}) AS text_md5, any_value(title) || ' > Summary' AS path, string_agg(id, '|' ORDER BY chunk_no) AS children
FROM parented GROUP BY parent, document_id""",
    "tree_children": f"{GROUPED} SELECT document_id, chunk_no AS ord, id, parent AS parent_id FROM parented",
    "tree_prompt": f"""{GROUPED}
SELECT parent AS id, md5('Title: ' || any_value(title) || chr(10) || 'Provider: ' || any_value(provider) || chr(10) || chr(10) ||
  string_agg('[' || path || ']' || chr(10) || trim(text, E' \\n\\t'), chr(10) ORDER BY chunk_no)) AS prompt_md5 FROM parented GROUP BY parent""",
    "tree_node_text": f"""{GROUPED}
SELECT parent AS id, md5('Title: ' || any_value(title) || chr(10) || 'Provider: ' || any_value(provider) || chr(10) || 'Section: Summary' || chr(10) || chr(10) || {SUMMARY}) AS text_md5
FROM parented GROUP BY parent""",
    "tree_collapse": f"""{GROUPED}
SELECT document_id AS query_id, id, 'leaf' AS node_type FROM parented WHERE g % 2 = 1
UNION ALL SELECT DISTINCT document_id, parent, 'summary' FROM parented WHERE g % 2 = 0""",
}

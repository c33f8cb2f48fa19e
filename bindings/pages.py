"""Page cleaning, blocks and sections over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import base as B
from gleaner.functions import text as T
from gleaner.operators import chunking as C
from gleaner.operators import pages as P
from gleaner.sources.tables import document_name


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a raw article titled by its url."""
    return B.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.col("url").alias("title"),
        F.lit("").alias("slug"),
        "html",
        F.lit("article").alias("content_type"),
        B.null().alias("provider"),
        F.col("url"),
        B.null().alias("published_at"),
        B.null().alias("updated_at"),
    )


def pages_clean(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "pages").select("page_id", F.md5(P.clean_html("html")).alias("clean_md5"))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.block_rows(B.table(spark, sf, "pages").select("page_id", "html"))
    return rows.select("page_id", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), "text")


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    documents = P.normalize_posts(posts(spark, sf))
    rows = documents.select("id", F.posexplode("sections").alias("pos", "s"))
    return rows.select(
        "id", "pos", "s.heading", F.array_join("s.heading_path", " > ").alias("path"), F.md5("s.text").alias("text_md5")
    )


def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = document_name(P.normalize_posts(posts(spark, sf)))
    return documents.select("id", "name", F.size("sections").alias("n_sections"))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to sections to children: the front half of the ingest in one plan."""
    chunks = C.child_chunks(P.normalize_posts(posts(spark, sf)))
    return chunks.select(
        "document_id", "chunk_no", "section", F.md5("text").alias("text_md5"), T.count_tokens(F.col("text")).alias("n")
    )


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    """A page from every document, with what ``pages`` lacks: two levels of headings,
    lists, a table, shortcodes, nbsp, empty nodes and a "jump to" list."""
    body = F.translate("text", "&<>[]\u00a0", "      ")
    html = F.concat(
        F.lit('<p>[ad id="1"]Intro&nbsp;&nbsp; about '), "source", F.lit("</p><div>Jump to:</div>"),
        F.lit('<ul><li><a href="#a">Alpha</a></li><li><a href="#c">Gamma</a></li></ul><h2>Alpha</h2><ul><li>one '),
        F.col("doc_id").cast("string"), F.lit("</li><li> </li><li>two</li></ul><h3>Beta</h3>"),
        F.lit("<table><tr><th>Key</th><th>Value</th></tr><tr><td>"), "lang", F.lit("</td><td>"),
        F.col("n_chars").cast("string"), F.lit("</td></tr></table><p> </p><span></span><h2>Gamma</h2>"),
        F.lit("<ol><li>first</li><li>second</li></ol><p>"), body, F.lit("</p>"),
    )
    return B.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.lit("").alias("slug"),
        html.alias("html"), F.lit("article").alias("content_type"), B.null().alias("provider"), B.null().alias("url"),
        B.null().alias("published_at"), B.null().alias("updated_at"), body.alias("body"),
    )


def page_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the derived pages; of Gamma the collapsed text."""
    rows = P.normalize_posts(_derived(spark, sf)).select("id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("id", "pos", "s.heading", F.array_join("s.heading_path", " > ").alias("path"),
                       F.md5(T.collapse_spaces(F.col("s.text"))).alias("text_md5"))


def plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without markup are split into paragraphs at blank lines."""
    text = F.replace(F.translate("text", "&<>[]\u00a0", "      "), F.lit("\n"), F.lit("\n \n"))
    rows = P.block_rows(B.table(spark, sf, "documents").select("doc_id", text.alias("html")))
    return rows.select("doc_id", "pos", "kind", F.md5(T.collapse_spaces(F.col("text"))).alias("text_md5"))


QUERIES = {
    "page_rules": page_rules,
    "plain_pages": plain_pages,
    "pages_clean": pages_clean,
    "page_blocks": page_blocks,
    "page_sections": page_sections,
    "page_documents": page_documents,
    "page_chunks": page_chunks,
}


# Character references as HTML reads them in text: the semicolon may be missing,
# as where a title was cut short. The ampersand comes last, so none is read twice.
REFERENCES = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}


def entities(text: str) -> str:
    for name, char in REFERENCES.items():
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


def escaped(markup: str) -> str:
    """Markup with its references read and what must be escaped written in one way."""
    markup = f"regexp_replace({markup}, '&(lt|gt);?', chr(1) || '\\1;', 'g')"
    return f"replace(replace({entities(markup)}, '&', '&amp;'), chr(1), '&')"


BODY = """
bodies AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(</body>|$)', 1),
           '(?s)<nav>.*?</nav>', ''), '(?s)<!--.*?-->', '', 'g') AS body FROM pages
)"""

TIDY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"

# The pages are flat: a div, one heading, paragraphs and a footer.
BLOCKS = f"""
{BODY},
pieces AS (
  SELECT page_id, url, regexp_extract(body, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
    regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    list_filter(list_transform(string_split(regexp_extract(body, '(?s)</h1>(.*?)</article>', 1), '<p>'),
      lambda p: {entities("trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")}),
      lambda p: p <> '') AS paragraphs,
    regexp_extract(body, '(?s)<footer>(.*?)</footer>', 1) AS footer
  FROM bodies
),
listed AS (
  SELECT page_id, url, list_filter(list_concat(
    [{{'kind': 'paragraph', 'level': 0, 'text': {entities(TIDY.format("ad"))}}}, {{'kind': 'heading', 'level': 1, 'text': {entities(TIDY.format("h1"))}}}],
    list_transform(paragraphs, lambda p: {{'kind': 'paragraph', 'level': 0, 'text': p}}),
    [{{'kind': 'paragraph', 'level': 0, 'text': {entities(TIDY.format("footer"))}}}]), lambda b: b.text <> '') AS bs
  FROM pieces
),
blocks AS (SELECT page_id, url, i - 1 AS pos, bs[i].kind AS kind, bs[i].level AS level, bs[i].text AS text
           FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM listed))"""

SECTIONS = f"""
{BLOCKS},
numbered AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS sec,
    max(CASE WHEN kind = 'heading' THEN text END) OVER (PARTITION BY page_id ORDER BY pos) AS h FROM blocks),
sections AS (
  SELECT CAST(page_id AS VARCHAR) AS id, url, row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS pos, heading,
    CASE WHEN heading = url THEN url ELSE url || ' > ' || heading END AS path, text
  FROM (SELECT page_id, url, sec, coalesce(any_value(h), url) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text
        FROM numbered WHERE kind <> 'heading' GROUP BY page_id, url, sec)
)"""

ORACLE = {
    "pages_clean": f"""WITH {BODY}
SELECT page_id, md5({escaped("replace(body, '<br>', '<br/></b></p>')")}) AS clean_md5 FROM bodies""",
    "page_blocks": f"WITH {BLOCKS} SELECT page_id, pos, kind, level, text FROM blocks",
    "page_sections": f"WITH {SECTIONS} SELECT id, pos, heading, path, md5(text) AS text_md5 FROM sections",
    "page_documents": f"""WITH {SECTIONS} SELECT id, 'article-' || id || '-' ||
  lower(trim(regexp_replace(url, '[^a-zA-Z0-9_-]+', '-', 'g'), '-')) AS name, count(*) AS n_sections FROM sections GROUP BY id, url""",
    "page_chunks": f"""WITH {SECTIONS},
cut AS (
  SELECT *, unnest(range(0, CAST(1 + ceil(greatest(len(ws) - 150, 0) / 110.0) AS BIGINT))) AS w
  FROM (SELECT *, {B.words_sql("text")} AS ws FROM sections)
),
texts AS (
  SELECT id, pos, w, heading, CASE WHEN len(ws) <= 150 THEN trim(text, E' \\n\\t') ELSE array_to_string(ws[w * 110 + 1 : w * 110 + 150], ' ') END AS text FROM cut
)
SELECT id AS document_id, row_number() OVER (PARTITION BY id ORDER BY pos, w) - 1 AS chunk_no, heading AS section,
  md5(text) AS text_md5, len({B.words_sql("text")}) AS n FROM texts""",
}

PLAIN = "trim(regexp_replace(translate({0}, '&<>[]' || chr(160), '      '), '\\s+', ' ', 'g'))"
ORACLE["page_rules"] = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'doc ' || doc_id AS title, *, {PLAIN.format("text")} AS body FROM documents)
SELECT id, 0 AS pos, title AS heading, title AS path, md5('Intro about ' || source) AS text_md5 FROM d
UNION ALL SELECT id, 1, 'Alpha', title || ' > Alpha', md5('- one ' || doc_id || ' - two') FROM d
UNION ALL SELECT id, 2, 'Beta', title || ' > Alpha > Beta', md5('Key | Value ' || lang || ' | ' || n_chars) FROM d
UNION ALL SELECT id, 3, 'Gamma', title || ' > Gamma', md5('1. first 2. second' || CASE WHEN body = '' THEN '' ELSE ' ' || body END) FROM d"""
ORACLE["plain_pages"] = f"""
WITH lines AS (
  SELECT doc_id, i, {PLAIN.format("parts[i]")} AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, 'paragraph' AS kind, md5(t) AS text_md5
FROM lines WHERE t <> ''"""

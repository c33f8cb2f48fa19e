"""The lexical index: one row per chunk, scored where it lies."""

from pyspark.sql import functions as F

from gleaner.operators import lexical
from gleaner.schemas import CHUNK, CHUNK_KEY, FILTER_COLUMNS


def chunk_table(spark):
    texts = ["price plan price", "plan", "", None, "other words", "price of the plan plan plan", "Price $9", "plan price"] * 3
    rows = [
        (("article", "review")[i % 2], str(i // 4), i % 4, f"c{i}", f"P{i % 3}", "t", f"Section {i % 2}", ["t", f"Section {i % 2}"], text, None, None, None)
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, CHUNK).repartition(3)


def test_one_row_per_chunk(spark):
    chunks = chunk_table(spark)
    index = lexical.build_index(chunks)
    assert index.postings.count() == chunks.count()
    counted = {(r.document_id, r.chunk_no): dict(zip(r.terms, r.tfs)) | {"": r.length} for r in index.postings.collect()}
    assert counted["1", 1] == {"1": 1, "of": 1, "p2": 1, "plan": 3, "price": 1, "section": 1, "t": 1, "the": 1, "": 10}
    assert index.stats.first().n == chunks.count()


def test_streamed_scores_are_the_joined_ones(spark):
    index = lexical.build_index(chunk_table(spark))
    asked = [(1, "price plan price", None, None, None, None), (2, "plan other", "P1", None, None, "section 1"),
             (3, "price", "", "review", None, "absent"), (4, "unknown", None, None, None, None), (5, "$9 the", None, None, "1", None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, " + ", ".join(f"{c} string" for c in FILTER_COLUMNS))
    terms = lexical.query_terms(queries)
    shown = ["query_id", *CHUNK_KEY, "matched", F.round("score", 9)]
    joined = lexical.score(index, terms, 100).select(*shown).collect()
    streamed = lexical.best_of_block(index, terms, 100, 1000).select(*shown).collect()
    assert len(joined) > 20 and sorted(map(tuple, joined)) == sorted(map(tuple, streamed))
